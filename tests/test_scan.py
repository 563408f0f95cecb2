import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coverlens.operators import geometry as G
from coverlens.operators.quantiles import exact_quantiles
from coverlens.operators.scan import running_sums, sums_below, with_next, with_previous


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": ["hot"] * 500 + ["a"] * 40 + ["b"], "t": [*rng.permutation(500), *rng.permutation(40), 0], "v": rng.integers(0, 90, 541).astype(float)})
    return pdf, spark.createDataFrame(pdf.astype({"t": int}))


def test_running_sums_and_neighbours_cross_chunks(skewed):
    pdf, df = skewed
    want = pdf.sort_values(["k", "t"])
    got = running_sums(df, ["k"], "t", {"s": F.col("v")}, width=16).toPandas().sort_values(["k", "t"])
    assert got.s.to_numpy() == pytest.approx(want.groupby("k").v.cumsum().to_numpy())
    for fn, shift, c in ((with_previous, 1, "prev_v"), (with_next, -1, "next_v")):
        got = fn(df, ["k"], "t", ["v"], width=16).toPandas().sort_values(["k", "t"])
        assert got[c].fillna(-1).tolist() == want.groupby("k").v.shift(shift).fillna(-1).tolist()


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_sums_below_is_exact(spark, n):
    rng = np.random.default_rng(n)
    v = np.unique(np.where(rng.random(n) < 0.5, rng.random(n) * 1e-6, rng.exponential(100, n)))
    pdf = pd.DataFrame({"k": 1, "v": v, "n": rng.integers(1, 5, len(v))})
    got = sums_below(spark.createDataFrame(pdf), ["k"], "v", ["n"]).toPandas().sort_values("v")
    assert got.n_below.tolist() == (pdf.n.cumsum() - pdf.n).tolist()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([np.full(700, 5.0), rng.normal(0, 30, 1301)])
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x}))
    r = exact_quantiles(df, ["g"], "x", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.993, "e": 1.0}).first()
    assert [r.a, r.b, r.c, r.d, r.e] == pytest.approx(np.quantile(x, [0, 0.25, 0.5, 0.993, 1]).tolist())


def test_rows_of_one_key_spread_over_tasks(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(old, ("false", "-1")):
            spark.conf.set(c, v)
        df = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id").alias("v"), F.lit(2).alias("n"))
        r = sums_below(df, ["k"], "v", ["n"], totals=True).withColumn("part", F.spark_partition_id())
        bad, largest = r.groupBy("part").agg(F.count_if((F.col("n_below") != 2 * F.col("v")) | (F.col("n_all") != 400_000)).alias("bad"), F.count("*").alias("n")).agg(F.sum("bad"), F.max("n")).first()
        assert bad == 0 and largest < 120_000
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_weighted_sample_keeps_every_draw_and_never_meets_a_type_whole(spark):
    f = spark.range(30_000).select(F.col("id").alias("feature_no"), F.col("id").cast("string").alias("feature_id"), F.lit("road").alias("feature_type"),
                                   F.when(F.col("id") % 5 == 0, 0.0).otherwise(1.0 / (1 + F.col("id"))).alias("area_probability"),
                                   F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(0.0).alias("y")) for i in range(3)]).alias("pts"))
    r = G.weighted_sample(f, 4000, 3)
    n, draws, zero, low = r.agg(F.count("*"), F.countDistinct("draw"), F.count_if(F.col("feature_id").cast("int") % 5 == 0), F.count_if(F.col("feature_id").cast("int") < 100)).first()
    assert (n, draws, zero) == (4000, 4000, 0)
    w = [0.0 if i % 5 == 0 else 1 / (1 + i) for i in range(30_000)]
    assert low / 4000 == pytest.approx(sum(w[:100]) / sum(w), abs=0.03)
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_split") and "Window [" in plan and "__p" in plan


def path(spark, pts):
    return spark.createDataFrame([("r", 0, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "run_id string, agent_id int, t int, x double, y double")


def test_trim_split_truncate(spark):
    p = path(spark, [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)])
    rows = G.trim_ends(p, F.col("t").isin(1, 3)).orderBy("t").collect()
    assert [r.t for r in rows] == [1, 2, 3] and (rows[0].prefix_removed, rows[0].suffix_removed) == (1, 1)
    parts = G.split_path(p, 2, exact=False).orderBy("part").collect()
    assert [(r.start_t, r.end_t) for r in parts] == [(0, 2), (2, 4)]
    half = G.truncate_path(p, 2.5).orderBy("t").collect()
    assert (half[-1].x, half[-1].cum) == (2.5, 2.5) and len(half) == 4
    s = G.resample_path(p, 1.5).orderBy("i").collect()
    assert [r.x for r in s] == pytest.approx([0, 4 / 3, 8 / 3, 4])


def test_nearest_feature_with_a_hot_place(spark):
    rng = np.random.default_rng(4)
    pts = np.concatenate([np.tile([[3.0, 3.0]], (200, 1)), rng.random((60, 2)) * 300 - 100])
    feats = [(str(i), [{"x": float(a), "y": float(b)}, {"x": float(a + c), "y": float(b + d)}]) for i, (a, b, c, d) in enumerate(rng.random((80, 4)) * [60, 60, 5, 5])]
    f = spark.createDataFrame(feats, "feature_id string, pts array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = {r.id: r.distance for r in G.nearest_feature(p, f, ["id"], 2.0, 64.0).collect()}

    def d(pt, e):
        a, b = np.array([e[0]["x"], e[0]["y"]]), np.array([e[1]["x"], e[1]["y"]])
        u = np.clip(np.dot(pt - a, b - a) / np.dot(b - a, b - a), 0, 1)
        return np.hypot(*(pt - a - u * (b - a)))

    assert len(got) == len(pts)
    assert [got[i] for i in range(len(pts))] == pytest.approx([min(d(pt, e) for _, e in feats) for pt in pts])


def test_far_points_of_a_tile_are_sent_once(spark, monkeypatch):
    """What walks down the pyramid grows with the tiles of points, not with the points; results as by brute force."""
    sent = []
    nearer = G._nearer
    monkeypatch.setattr(G, "_nearer", lambda *a: sent.append(nearer(*a)) or sent[-1])
    rng = np.random.default_rng(8)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.uniform(200, 207, (300, 2)), rng.uniform(0, 20, (60, 2))]))]
    seg = rng.uniform(0, 20, (200, 2))
    f = spark.createDataFrame([(str(i), [(float(x), float(y)), (float(x) + 1, float(y))]) for i, (x, y) in enumerate(seg)], "feature_id string, pts array<struct<x:double,y:double>>")
    got = {r.id: r.distance for r in G.nearest_feature(spark.createDataFrame(pts, "id int, x double, y double"), f, ["id"], 1.0, 32.0).collect()}
    for i, x, y in pts:
        assert got[i] == pytest.approx(np.hypot(np.maximum(np.maximum(seg[:, 0] - x, x - seg[:, 0] - 1), 0), seg[:, 1] - y).min())
    assert sent[0].select("tx", "ty").distinct().count() <= 4 + 36 and all(s.where("tx >= 50").count() <= 4 * 200 for s in sent)


def test_grid_totals_and_ranks_of_a_hot_key(spark):
    """A single grid's rows share out their totals; one value of x that holds most rows changes no correlation."""
    from coverlens.operators import grid as R
    from coverlens.operators import summaries as M

    cells = spark.createDataFrame([("g", i, 0, float(i), i % 3 > 0) for i in range(500)], "grid_id string, row int, col int, p double, valid boolean").repartition(4)
    mixed = R.mix_uniform(cells, 0.25)
    valid = sum(i % 3 > 0 for i in range(500))
    for r in mixed.collect():
        assert r.p == pytest.approx(0.75 * r.row / (499 * 250) + 0.25 * r.valid / valid)
    joined = str(mixed._jdf.queryExecution().optimizedPlan())
    assert "_split" in joined
    rng = np.random.default_rng(2)
    x = np.where(rng.random(900) < 0.8, 5, rng.integers(0, 9, 900))
    y = (x + rng.integers(0, 12, 900)) // 2
    got = M.association(spark.createDataFrame([("a", int(u), int(v)) for u, v in zip(x, y)], "k string, x int, y int"), ["k"], "x", "y")
    assert "_rx" not in str(got._jdf.queryExecution().analyzed()).split("corr(")[1].split(")")[0]
    row, p = got.first(), pd.DataFrame({"x": x, "y": y})
    assert row.spearman == pytest.approx(p["x"].rank().corr(p["y"].rank())) and row.pearson == pytest.approx(p["x"].corr(p["y"])) and row.n == 900
