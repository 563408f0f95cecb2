"""Queries over sources, grids, priors and features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlens.functions.hashing import stable_hash, trajectory_hash
from coverlens.operators import exposure as X
from coverlens.operators import geometry as G
from coverlens.operators import grid as R
from coverlens.operators import shapes as SH
from coverlens.operators.quantiles import exact_quantiles
from coverlens.plans.ctes import CELL, FOOT, PING, runs, with_
from coverlens.plans.experiments import RUNS, RUNS_K
from coverlens.plans.registry import query, rounded
from coverlens.sources import adapters as A
from coverlens.sources import io as IO

# ---- sources and ingest ---------------------------------------------------------------------------------------------

CSV_SCHEMA = T.StructType([T.StructField("dataset", T.IntegerType()), T.StructField("planning_seed", T.IntegerType()), T.StructField("planning_mode", T.StringType()),
                           T.StructField("P_detect", T.DoubleType()), T.StructField("RMST", T.DoubleType()), T.StructField("L", T.DoubleType()), T.StructField("T", T.IntegerType())])
RUN_COLS = [f.name for f in CSV_SCHEMA.fields]


@query("read_runs", with_(RUNS, select='SELECT dataset, planning_seed, planning_mode, round("P_detect", 9) AS "P_detect", round("RMST", 9) AS "RMST", round("L", 9) AS "L", "T" FROM runs'))
def _(spark, d):
    path = IO.scratch_path(spark, "runs-csv")
    IO.write_table(A.runs(spark, d).select(*RUN_COLS), path, "csv", header=True, compression="gzip")
    return rounded(IO.read_runs(spark, path, CSV_SCHEMA))


@query("write_table", with_(RUNS, select='SELECT dataset, count(*) AS "rows", round(sum("P_detect"), 8) AS total FROM runs GROUP BY 1'))
def _(spark, d):
    path = IO.scratch_path(spark, "runs")
    IO.write_table(A.runs(spark, d), path, partition_by=["dataset"])
    return rounded(spark.read.parquet(path).groupBy("dataset").agg(F.count("*").alias("rows"), F.sum("P_detect").alias("total")), 8)


@query("coerce_numeric", """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN NULL ELSE CAST(round(value, 2) AS VARCHAR) END AS DOUBLE) AS "P_detect" FROM events""")
def _(spark, d):
    e = A.table(spark, d, "events")
    raw = F.when(F.col("event_type") == "error", "none").when(F.col("event_type") == "view", "n/a").otherwise(F.round("value", 2).cast("string"))
    return IO.coerce_numeric(e.select("event_id", raw.alias("P_detect")), ["P_detect"])


@query("union_runs", """SELECT source, count(*) AS n, count(k) AS with_k, round(sum(v), 2) AS total FROM (SELECT 'orders' AS source, NULL AS k, o_totalprice AS v FROM orders UNION ALL SELECT 'lineitem', l_linenumber, l_extendedprice FROM lineitem) GROUP BY 1""")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_totalprice").alias("v"))
    li = A.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("v"), F.col("l_linenumber").alias("k"))
    u = IO.union_runs({"orders": o, "lineitem": li})
    return rounded(u.groupBy("source").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.sum("v").alias("total")), 2)


@query("tagged_files", """SELECT source, count(*) AS n FROM (SELECT 'orders.parquet' AS source FROM orders UNION ALL SELECT 'customer.parquet' FROM customer) GROUP BY 1""")
def _(spark, d):
    return IO.read_parquet_tagged(spark, [f"{d}/orders.parquet", f"{d}/customer.parquet"]).groupBy("source").agg(F.count("*").alias("n"))


@query("read_features", """SELECT CAST(c_custkey // 64 AS VARCHAR) AS grid_id, 'dry' AS climate, CAST(c_custkey AS VARCHAR) AS feature_id, CASE WHEN c_custkey % 3 = 0 THEN 'LineString' ELSE 'Polygon' END AS geom_type,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 5 END AS INT) AS n_points, CAST(c_custkey % 61 AS DOUBLE) AS x0, CAST((c_custkey // 61) % 97 AS DOUBLE) AS y0 FROM customer""")
def _(spark, d):
    f = A.features(spark, d)
    xy = F.transform("pts", lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.col("geom_type").alias("type"), F.when(F.col("geom_type") == "Polygon", F.to_json(F.array(xy))).otherwise(F.to_json(xy)).alias("coordinates"))
    item = F.struct(F.struct(F.col("feature_id").alias("id"), "feature_type", F.lit(0.5).alias("area_probability")).alias("properties"), geometry.alias("geometry"))
    col = f.groupBy(F.floor(F.col("feature_no") / 64).cast("string").alias("grid_id")).agg(F.collect_list(item).alias("features"))
    path = IO.scratch_path(spark, "geojson")
    text = col.select(F.to_json(F.struct("grid_id", F.lit("dry").alias("climate"), F.lit("flat").alias("environment_type"), "features")).alias("value"))
    IO.write_table(text, path, "parquet")
    p = IO.parse_features(spark.read.parquet(path), "value")
    return p.select("grid_id", "climate", "feature_id", "geom_type", F.size("pts").alias("n_points"), F.col("pts")[0]["x"].alias("x0"), F.col("pts")[0]["y"].alias("y0"))


@query("grid_from_arrays", 'SELECT CAST(vec_id AS VARCHAR) AS grid_id, CAST(0 AS INT) AS "row", CAST(i - 1 AS INT) AS col, round(CAST(embedding[i] AS DOUBLE), 9) AS p FROM embeddings, range(1, 65) r(i)')
def _(spark, d):
    v = A.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("grid_id"), F.array(F.col("embedding").cast("array<double>")).alias("values"))
    return rounded(R.grid_from_arrays(v))


@query("latest_campaign", "SELECT o_orderpriority AS stage, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS directory, max(o_orderdate) AS \"timestamp\" FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("directory"), "o_orderstatus")
    return IO.latest_campaign(o, has_runs=F.col("o_orderstatus") != "P")


@query("flatten_runs", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders")
def _(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.struct("o_orderstatus", "o_totalprice").alias("metrics"), F.struct("o_custkey").alias("ids"))
    return IO.flatten_runs(o, ["metrics", "ids"])


@query("stamp_provenance", with_(RUNS, select="""SELECT dataset, planning_seed, planning_mode, 'c5' AS stage, 'none' AS source_hash, '{"w":' || dataset || '}' AS condition_key, sha256('{"w":' || dataset || '}') AS condition_key_hash FROM runs"""))
def _(spark, d):
    r = A.runs(spark, d).select("dataset", "planning_seed", "planning_mode", F.to_json(F.struct(F.col("dataset").alias("w"))).alias("condition_key"))
    return IO.stamp_provenance(r, {"stage": "c5"}, ["stage", "source_hash", "condition_key", "condition_key_hash"])


@query("stable_hash", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS hash FROM orders""")
def _(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", stable_hash("o_orderstatus", "o_orderkey", "o_custkey").alias("hash"))


@query("trajectory_hash", with_(PING, """
tc AS (SELECT run_id, agent_id, t // 4096 AS c, md5(string_agg(agent_id || ',' || t || ',' || CAST(round(x * 100) AS BIGINT) || ',' || CAST(round(y * 100) AS BIGINT), ';' ORDER BY t)) AS h FROM ping GROUP BY ALL),
ta AS (SELECT run_id, agent_id, md5(string_agg(h, ';' ORDER BY c)) AS h FROM tc GROUP BY ALL),
tp AS (SELECT run_id, agent_id // 4096 AS c, md5(string_agg(h, ';' ORDER BY agent_id)) AS h FROM ta GROUP BY ALL)""", select="SELECT run_id, sha256(string_agg(h, ';' ORDER BY c)) AS trajectory_hash FROM tp GROUP BY run_id"))
def _(spark, d):
    return trajectory_hash(A.pings(spark, d), ["run_id"])


DESIGN = """
dg AS (SELECT CAST(l AS INT) AS k, dataset, planning_seed, m AS planning_mode FROM (SELECT CAST(s_nationkey AS INT) AS dataset, CAST(s_suppkey AS INT) AS planning_seed FROM supplier), (SELECT unnest(range(0, 9)) AS l), (SELECT unnest(['A', 'N', 'R', 'X']) AS m))"""


def _design(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("dataset"), F.col("s_suppkey").cast("int").alias("planning_seed"))
    return IO.design_grid(s, {"k": list(range(9)), "planning_mode": ["A", "N", "R", "X"]})


@query("design_grid", with_(DESIGN, select="SELECT dataset, planning_seed, k, planning_mode FROM dg"))
def _(spark, d):
    return _design(spark, d)


@query("pending_design", with_(DESIGN, RUNS_K, select="SELECT dataset, planning_seed, k, planning_mode FROM dg EXCEPT SELECT dataset, planning_seed, k, planning_mode FROM runs"))
def _(spark, d):
    return IO.pending_design(_design(spark, d), A.runs(spark, d, True), ["dataset", "planning_seed", "k", "planning_mode"])


# ---- grid transforms --------------------------------------------------------------------------------------------------

LL = "ll AS (SELECT c_custkey, c_acctbal / 60.0 AS lon, c_acctbal / 150.0 - 20 AS lat FROM customer)"


@query("utm_epsg", with_(LL, select="SELECT c_custkey, 'EPSG:' || CASE WHEN lat >= 0 THEN '326' ELSE '327' END || lpad(CAST(CAST(trunc((lon + 180) / 6) AS INT) + 1 AS VARCHAR), 2, '0') AS epsg FROM ll"))
def _(spark, d):
    c = A.table(spark, d, "customer")
    return c.select("c_custkey", R.utm_epsg(F.col("c_acctbal") / 60.0, F.col("c_acctbal") / 150.0 - 20).alias("epsg"))


@query("to_cell", with_(PING, FOOT.split(",\nfoot AS")[0], select="""SELECT run_id, agent_id, t, CAST(trunc((y - 3.5) / 2.5) AS INT) AS "row", CAST(trunc((x - 1.5) / 2.5) AS INT) AS col,
    CAST(greatest(0, least(n_rows - 1, trunc((y - 3.5) / 2.5))) AS INT) AS clipped_row, CAST(greatest(0, least(63, trunc((x - 1.5) / 2.5))) AS INT) AS clipped_col FROM ping, spec"""))
def _(spark, d):
    g = R.GridSpec(A.grid_spec(spark, d).rows, 64, 1.5, 3.5, 2.5, 2.5)
    p = A.pings(spark, d)
    r, c = R.to_cell(F.col("x"), F.col("y"), g)
    rc, cc = R.to_cell(F.col("x"), F.col("y"), g, clip=True)
    return p.select("run_id", "agent_id", "t", r.alias("row"), c.alias("col"), rc.alias("clipped_row"), cc.alias("clipped_col"))


@query("cell_center", with_(CELL, select='SELECT "row", col, 1.5 + (col + 0.5) * 2.5 AS cx, 3.5 + ("row" + 0.5) * 2.5 AS cy, CAST(col * 2.5 + 1.5 AS DOUBLE) AS x0, CAST("row" * 2.5 + 3.5 AS DOUBLE) AS y0 FROM cell').replace("1.5 + (col + 0.5) * 2.5 AS cx, 3.5 + (\"row\" + 0.5) * 2.5 AS cy", "CAST(1.5 + (col + 0.5) * 2.5 AS DOUBLE) AS cx, CAST(3.5 + (\"row\" + 0.5) * 2.5 AS DOUBLE) AS cy"))
def _(spark, d):
    g = R.GridSpec(1, 1, 1.5, 3.5, 2.5, 2.5)
    cx, cy = R.cell_center(F.col("row"), F.col("col"), g)
    x0, y0 = R.cell_corner(F.col("row"), F.col("col"), g)
    return A.cells(spark, d).select("row", "col", cx.alias("cx"), cy.alias("cy"), x0.alias("x0"), y0.alias("y0"))


@query("footprint_radius", "SELECT p_partkey, round(p_retailprice / 10.0 * tan(radians((p_size + 10.0) / 2)), 6) AS radius FROM part")
def _(spark, d):
    return rounded(A.table(spark, d, "part").select("p_partkey", R.footprint_radius(F.col("p_retailprice") / 10.0, F.col("p_size") + 10.0).alias("radius")), 6)


@query("normalize_grid", with_(CELL, select='SELECT grid_id, "row", col, round(p, 12) AS p FROM cell'))
def _(spark, d):
    w = A.cell_weights(spark, d).select("grid_id", "row", "col", F.col("w").cast("double").alias("p"))
    return rounded(R.normalize_grid(w), 12)


@query("mix_uniform", with_(CELL, select='SELECT "row", col, round(0.75 * p + 0.25 * CASE WHEN valid THEN 1.0 / (SELECT count(*) FROM cell WHERE valid) ELSE 0 END, 12) AS p FROM cell'))
def _(spark, d):
    return rounded(R.mix_uniform(A.cells(spark, d), 0.25).select("row", "col", "p"), 12)


OBS = """
obs AS (SELECT DISTINCT "row", col FROM foot)"""
FOCAL = """
wv AS (SELECT c."row", c.col, valid, CASE WHEN o."row" IS NULL THEN p ELSE 0.5 * p END AS v FROM cell c LEFT JOIN obs o ON o."row" = c."row" AND o.col = c.col),
fs AS (SELECT a."row", a.col, CASE WHEN any_value(a.valid) THEN sum(b.v) ELSE '-infinity'::DOUBLE END AS score FROM wv a JOIN (SELECT "row" + dr AS "row", col + dc AS col, v FROM wv, range(-1, 2) x(dr), range(-1, 2) y(dc)) b ON a."row" = b."row" AND a.col = b.col GROUP BY ALL)"""


def _focal(spark, d):
    """Whole weights and their halves add up exactly in any order; the total, which no valid cell lacks, divides the sums."""
    g, w = A.grid_spec(spark, d), A.cell_weights(spark, d)
    s = R.focal_score(w.withColumn("p", F.col("w").cast("double")), R.footprint(A.pings(spark, d), g, 1.5), g, 1.5, 0.5)
    return s.withColumn("score", F.coalesce(F.col("score") / w.agg(F.sum("w")).scalar(), "score"))


@query("focal_score", with_(PING, FOOT, CELL, OBS, FOCAL, select='SELECT "row", col, round(score, 10) AS score FROM fs'))
def _(spark, d):
    return rounded(_focal(spark, d), 10)


NB = """
nb AS (SELECT a."row", a.col, max(b.v) AS m FROM {0} a JOIN (SELECT "row" + dr AS "row", col + dc AS col, {1} AS v FROM {0}, range(-1, 2) x(dr), range(-1, 2) y(dc) WHERE dr <> 0 OR dc <> 0) b ON a."row" = b."row" AND a.col = b.col GROUP BY ALL)"""


@query("neighbor_max", with_(CELL, NB.format("cell", "p"), select='SELECT "row", col, round(m, 12) AS neighbor_max FROM nb'))
def _(spark, d):
    return rounded(R.neighbor_max(A.cells(spark, d).select("row", "col", F.col("p").alias("v"))), 12)


@query("value_map", with_(PING, FOOT, CELL, OBS, FOCAL, NB.format("fs", "score"), 'v2 AS (SELECT fs."row", fs.col, score, score + m AS v FROM fs JOIN nb USING ("row", col))', NB.format("v2", "v").replace("nb AS", "nb2 AS"),
                            select='SELECT v2."row", v2.col, round(score + m, 10) AS v FROM v2 JOIN nb2 USING ("row", col)'))
def _(spark, d):
    return rounded(R.value_map(_focal(spark, d), 3), 10)


@query("clip_grid", with_(CELL, select="""SELECT "row", col, round(CASE WHEN (col + 0.5 - 32) * (col + 0.5 - 32) + ("row" + 0.5 - 100) * ("row" + 0.5 - 100) <= 400 THEN p ELSE 0 END, 12) AS p FROM cell WHERE abs(col + 0.5 - 32) <= 20 AND abs("row" + 0.5 - 100) <= 20"""))
def _(spark, d):
    return rounded(R.clip_grid(A.cells(spark, d), A.grid_spec(spark, d), 32.0, 100.0, 20.0).select("row", "col", "p"), 12)


ENV = """
en AS (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'flat' ELSE 'mountainous' END AS env_type, CASE WHEN s_suppkey % 2 = 0 THEN 'dry' ELSE 'temperate' END AS climate, CASE s_suppkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'xlarge' END AS size FROM supplier),
rk AS (SELECT * FROM (VALUES """ + ", ".join(f"('{e}', '{c}', '{s}', {r})" for (e, c), km in G.RADIUS_KM.items() for s, r in zip(G.SIZES, km)) + """) v(env_type, climate, size, radius_km))"""


@query("radius_lookup", with_(ENV, select="SELECT s_suppkey, env_type, climate, size, CAST(radius_km AS DOUBLE) AS radius_km FROM en LEFT JOIN rk USING (env_type, climate, size)"))
def _(spark, d):
    s = A.table(spark, d, "supplier")
    size = F.element_at(F.array(*[F.lit(x) for x in G.SIZES]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return G.radius_lookup(s.select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, "flat").otherwise("mountainous").alias("env_type"),
                                    F.when(F.col("s_suppkey") % 2 == 0, "dry").otherwise("temperate").alias("climate"), size.alias("size")))


LNF = """
qv AS (SELECT o_orderpriority, unnest([0.25, 0.5, 0.75, 0.95]) AS prob, ln(unnest([quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.75), quantile_cont(o_totalprice, 0.95)])) AS y,
    unnest([-0.6744897501960817, 0.0, 0.6744897501960817, 1.6448536269514722]) AS z FROM orders GROUP BY 1)"""


@query("fit_lognormal", with_(LNF, select="SELECT o_orderpriority, round(regr_intercept(y, z), 7) AS mu, round(abs(regr_slope(y, z)), 7) AS sigma, round(sqrt((regr_syy(y, z) - regr_sxy(y, z) * regr_sxy(y, z) / regr_sxx(y, z)) / 4), 7) AS rmse FROM qv GROUP BY 1"))
def _(spark, d):
    q = exact_quantiles(A.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95})
    long = q.select("o_orderpriority", F.explode(F.array(*[F.struct(F.lit(p).alias("prob"), F.col(c).alias("value")) for c, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95))])).alias("s")).select("o_orderpriority", "s.*")
    return rounded(G.fit_lognormal(long, ["o_orderpriority"]), 7)


MU, SIG = -2.0, 0.9
PDF = f"1 / (greatest(km, 1e-6) * {SIG} * sqrt(2 * pi())) * exp(-pow(ln(greatest(km, 1e-6)) - ({MU}), 2) / (2 * {SIG} * {SIG}))"
DP = f"""
dp0 AS (SELECT "row", col, sqrt((col - 32.0) * (col - 32.0) + ("row" - 250.0) * ("row" - 250.0)) / 1000.0 AS km, p AS f FROM cell),
dp1 AS (SELECT *, {PDF} AS g FROM dp0), dp AS (SELECT *, g / sum(g) OVER () AS d FROM dp1)"""


def _dprior(spark, d):
    return R.distance_prior(A.cells(spark, d), A.grid_spec(spark, d), 32.0, 250.0, F.lit(MU), F.lit(SIG))


@query("distance_prior", with_(CELL, DP, select='SELECT "row", col, round(d, 10) AS p FROM dp'))
def _(spark, d):
    return rounded(_dprior(spark, d).select("row", "col", "p"), 10)


@query("combine_prior", with_(CELL, DP, select='SELECT "row", col, round(d * f / sum(d * f) OVER (), 10) AS p FROM dp'))
def _(spark, d):
    return rounded(R.combine_prior(_dprior(spark, d), A.cells(spark, d)).select("row", "col", "p"), 10)


@query("bin_distribution", with_(PING, FOOT.split(",\nfoot AS")[0], """
b AS (SELECT CAST(trunc(y) AS INT) AS "row", CAST(trunc(x) AS INT) AS col FROM ping),
h AS (SELECT "row", col, count(*) AS n FROM b, spec WHERE "row" >= 0 AND "row" < n_rows AND col >= 0 AND col < 64 GROUP BY ALL)""", select="""SELECT "row", col, n, round(n / (SELECT sum(n) FROM h), 9) AS q, CAST((SELECT sum(n) FROM h) AS BIGINT) AS valid_samples, round((SELECT sum(n) FROM h) / (SELECT count(*) FROM ping), 9) AS valid_fraction FROM h"""))
def _(spark, d):
    return rounded(R.bin_distribution(A.pings(spark, d), A.grid_spec(spark, d)))


# ---- features ---------------------------------------------------------------------------------------------------------

FT = """
ft0 AS (SELECT c_custkey AS no, CAST(c_custkey AS VARCHAR) AS feature_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'road' WHEN 'BUILDING' THEN 'structure' WHEN 'FURNITURE' THEN 'woodland' WHEN 'HOUSEHOLD' THEN 'field' ELSE 'linear' END AS feature_type, c_custkey % 3 = 0 AS line,
    CAST(c_custkey % 61 AS DOUBLE) AS x, CAST((c_custkey // 61) % 97 AS DOUBLE) AS y, CAST(1 + c_nationkey % 3 AS DOUBLE) AS s FROM customer),
ft AS (SELECT *, CASE WHEN line THEN [{'x': x, 'y': y}, {'x': x + s * 3, 'y': y}, {'x': x + s * 3, 'y': y + s * 4}] ELSE [{'x': x, 'y': y}, {'x': x + s, 'y': y}, {'x': x + s, 'y': y + s * 2}, {'x': x, 'y': y + s}, {'x': x, 'y': y}] END AS pts FROM ft0),
ed AS (SELECT no, feature_id, feature_type, line, i - 1 AS seg, pts[i] AS a, pts[i + 1] AS b FROM (SELECT *, unnest(range(1, len(pts))) AS i FROM ft))"""

DEN = """
dn0 AS (SELECT no, feature_id, feature_type, line, seg, a, b, greatest(1, CAST(trunc(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.7) AS INT)) AS n FROM ed),
dn AS (SELECT feature_id, feature_type, line, seg, i, a.x + i / n * (b.x - a.x) AS x, a.y + i / n * (b.y - a.y) AS y FROM (SELECT *, unnest(range(0, n)) AS i FROM dn0)
    UNION ALL SELECT feature_id, feature_type, line, len(pts) - 1, 0, pts[len(pts)].x, pts[len(pts)].y FROM ft)"""


@query("densify", with_(FT, DEN, select="SELECT feature_id, CAST(seg AS INT) AS seg, CAST(i AS INT) AS i, round(x, 8) AS x, round(y, 8) AS y FROM dn"))
def _(spark, d):
    return rounded(G.densify(A.features(spark, d).select("feature_id", "pts"), 0.7), 8)


@query("clip_features", with_(FT, DEN, select="SELECT feature_id, CAST(seg AS INT) AS seg, CAST(i AS INT) AS i, round(x, 8) AS x, round(y, 8) AS y FROM dn WHERE (x - 30) * (x - 30) + (y - 20) * (y - 20) <= 225"))
def _(spark, d):
    return rounded(G.clip_features(A.features(spark, d).select("feature_id", "pts"), 30.0, 20.0, 15.0, 0.7), 8)


RINGS = """
rf AS (SELECT c_custkey AS feature_id, CAST(c_custkey % 61 AS DOUBLE) AS x, CAST((c_custkey // 61) % 97 AS DOUBLE) AS y, CAST(5 + c_nationkey % 4 AS DOUBLE) AS a FROM customer),
rp AS (SELECT feature_id, part, ring, i, x + u AS px, y + v AS py FROM rf, LATERAL (VALUES (0, 0, 0, 0.0, 0.0), (0, 0, 1, a, 0.0), (0, 0, 2, a + 2, a), (0, 0, 3, 0.0, a), (0, 1, 0, 2.0, 2.0), (0, 1, 1, 2.0, a - 2), (0, 1, 2, a - 2, a - 2),
    (1, 0, 0, -3.0, -3.0), (1, 0, 1, -1.0, -3.0), (1, 0, 2, -1.0, -1.0)) v(part, ring, i, u, v)),
re AS (SELECT feature_id, part, ring, px AS ax, py AS ay, coalesce(lead(px) OVER w, first_value(px) OVER w) AS bx, coalesce(lead(py) OVER w, first_value(py) OVER w) AS by_ FROM rp WINDOW w AS (PARTITION BY feature_id, part, ring ORDER BY i))"""
SPEC = FOOT.split(",\nfoot AS")[0]


# every cell of the bounding box by a ray through all edges
@query("fill_holes", with_(RINGS, SPEC, """
iw AS (SELECT feature_id, part, trunc(ax) AS ax, trunc(ay) AS ay, trunc(bx) AS bx, trunc(by_) AS by_ FROM re),
ib AS (SELECT feature_id, part, CAST(min(ax) AS INT) AS c0, CAST(max(ax) AS INT) AS c1, CAST(min(ay) AS INT) AS r0, CAST(max(ay) AS INT) AS r1 FROM iw GROUP BY ALL),
ic AS (SELECT feature_id, part, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM ib)),
it AS (SELECT feature_id, part, r, c, sum(CASE WHEN (ay <= r) <> (by_ <= r) AND c < ax + (r - ay) * (bx - ax) / (by_ - ay) THEN 1 ELSE 0 END) % 2 = 1 AS ins,
    bool_or((bx - ax) * (r - ay) = (c - ax) * (by_ - ay) AND c BETWEEN least(ax, bx) AND greatest(ax, bx) AND r BETWEEN least(ay, by_) AND greatest(ay, by_)) AS edge FROM ic JOIN iw USING (feature_id, part) GROUP BY ALL)""", select="""
    SELECT feature_id, CAST(part AS INT) AS part, count(*) AS cells, CAST(sum(r * 1000 + c) AS BIGINT) AS places FROM it, spec WHERE (ins OR edge) AND r >= 0 AND r < n_rows AND c >= 0 AND c < 64 GROUP BY ALL"""))
def _(spark, d):
    parts = SH.multi_parts(A.ring_features(spark, d), ["feature_id"])
    cells = SH.fill_cells(parts, A.grid_spec(spark, d), ["feature_id", "part"])
    return cells.groupBy("feature_id", "part").agg(F.count("*").alias("cells"), F.sum(F.col("row").cast("long") * 1000 + F.col("col")).alias("places"))


# the area inside the circle of radius 12 around (30, 8): triangle of the part inside, sectors of the parts outside
@query("clip_areas", with_(RINGS, """
ce AS (SELECT feature_id, part, ring, ax - 30 AS ax, ay - 8 AS ay, bx - 30 AS bx, by_ - 8 AS by_, bx - ax AS dx, by_ - ay AS dy FROM re),
cq AS (SELECT *, dx * dx + dy * dy AS qa, ax * dx + ay * dy AS qb, pow(ax * dx + ay * dy, 2) - (dx * dx + dy * dy) * (ax * ax + ay * ay - 144) AS disc FROM ce),
ct AS (SELECT *, CASE WHEN disc > 0 THEN greatest(0.0, (-qb - sqrt(greatest(disc, 0))) / qa) ELSE 2.0 END AS t0, CASE WHEN disc > 0 THEN least(1.0, (-qb + sqrt(greatest(disc, 0))) / qa) ELSE -1.0 END AS t1 FROM cq),
cs AS (SELECT *, ax + t0 * dx AS ux, ay + t0 * dy AS uy, ax + t1 * dx AS vx, ay + t1 * dy AS vy FROM ct),
ca AS (SELECT feature_id, part, ring, abs(sum(CASE WHEN t0 >= t1 THEN 72 * atan2(ax * by_ - bx * ay, ax * bx + ay * by_)
    ELSE 72 * atan2(ax * uy - ux * ay, ax * ux + ay * uy) + (ux * vy - vx * uy) / 2 + 72 * atan2(vx * by_ - bx * vy, vx * bx + vy * by_) END)) AS area FROM cs GROUP BY ALL)""",
                           select="SELECT feature_id, CAST(part AS INT) AS part, round(abs(sum(CASE WHEN ring = 0 THEN area ELSE -area END)), 6) AS area FROM ca GROUP BY ALL"))
def _(spark, d):
    parts = SH.multi_parts(A.ring_features(spark, d), ["feature_id"])
    return SH.clip_areas(parts, 30.0, 8.0, 12.0, ["feature_id", "part"]).select("feature_id", "part", F.abs(F.round("area", 6)).alias("area"))


@query("clip_lines", with_(FT, """
cl AS (SELECT no, a.x - 30 AS ax, a.y - 8 AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM ed WHERE line),
cm AS (SELECT no, sqrt(dx * dx + dy * dy) AS len, -(ax * dx + ay * dy) / (dx * dx + dy * dy) AS mid, pow(ax * dx + ay * dy, 2) / pow(dx * dx + dy * dy, 2) - (ax * ax + ay * ay - 144) / (dx * dx + dy * dy) AS h FROM cl WHERE dx * dx + dy * dy > 0)""",
                           select="SELECT CAST(no AS VARCHAR) AS feature_id, round(sum(len * (least(1.0, mid + sqrt(h)) - greatest(0.0, mid - sqrt(h)))), 6) AS length, count(*) AS pieces FROM cm WHERE h > 0 AND least(1.0, mid + sqrt(h)) > greatest(0.0, mid - sqrt(h)) GROUP BY no"))
def _(spark, d):
    lines = A.features(spark, d).where("geom_type = 'LineString'")
    return rounded(SH.clip_lines(lines, 30.0, 8.0, 12.0, ["feature_id"]).groupBy("feature_id").agg(F.sum("length").alias("length"), F.count("*").alias("pieces")), 6)


RAS = """
lc AS (SELECT feature_type, CAST(trunc(y) AS INT) AS "row", CAST(trunc(x) AS INT) AS col FROM dn WHERE line),
pe AS (SELECT no, feature_type, CAST(trunc(a.x) AS INT) AS ax, CAST(trunc(a.y) AS INT) AS ay, CAST(trunc(b.x) AS INT) AS bx, CAST(trunc(b.y) AS INT) AS by_ FROM ed WHERE NOT line),
bb AS (SELECT no, feature_type, min(least(ax, bx)) AS c0, max(greatest(ax, bx)) AS c1, min(least(ay, by_)) AS r0, max(greatest(ay, by_)) AS r1 FROM pe GROUP BY ALL),
px AS (SELECT no, feature_type, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM bb)),
pp AS (SELECT px.no, px.feature_type, r, c, sum(CASE WHEN (ay <= r) <> (by_ <= r) AND c < ax + (r - ay) * (bx - ax) / CAST(by_ - ay AS DOUBLE) THEN 1 ELSE 0 END) % 2 = 1 AS ins,
    bool_or((bx - ax) * (r - ay) = (c - ax) * (by_ - ay) AND c BETWEEN least(ax, bx) AND greatest(ax, bx) AND r BETWEEN least(ay, by_) AND greatest(ay, by_)) AS edge FROM px JOIN pe ON pe.no = px.no GROUP BY ALL),
ras AS (SELECT DISTINCT feature_type, "row", col FROM (SELECT feature_type, "row", col FROM lc UNION ALL SELECT feature_type, r, c FROM pp WHERE ins OR edge), spec WHERE "row" >= 0 AND "row" < n_rows AND col >= 0 AND col < 64)"""


@query("rasterize", with_(FT, DEN, SPEC, RAS, select='SELECT feature_type, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, 1.0::DOUBLE AS mark FROM ras'))
def _(spark, d):
    return G.rasterize(A.features(spark, d), A.grid_spec(spark, d), 0.7)


WT = "wt AS (SELECT * FROM (VALUES ('road', 0.13), ('structure', 0.13), ('woodland', 0.07), ('field', 0.14), ('linear', 0.25)) v(feature_type, weight))"


def _types(spark):
    return spark.createDataFrame(list(G.FEATURE_PROBABILITIES.items()), "feature_type string, weight double")


@query("combine_layers", with_(FT, DEN, SPEC, RAS, WT, select='SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, CAST(max(weight) AS DOUBLE) AS p FROM ras JOIN wt USING (feature_type) GROUP BY ALL'))
def _(spark, d):
    return R.combine_layers(G.rasterize(A.features(spark, d), A.grid_spec(spark, d), 0.7), _types(spark))


FW = f"""
sh AS (SELECT no, feature_type, line, sum(a.x * b.y - b.x * a.y) AS cr, sum((a.x + b.x) * (a.x * b.y - b.x * a.y)) AS cxs, sum((a.y + b.y) * (a.x * b.y - b.x * a.y)) AS cys, sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS len,
    sum((a.x + b.x) / 2 * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS lx, sum((a.y + b.y) / 2 * sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS ly FROM ed GROUP BY ALL),
sg AS (SELECT no, feature_type, CASE WHEN line THEN len * 30 + pi() * 225 ELSE abs(cr / 2) END AS area, CASE WHEN line THEN lx / len ELSE cxs / (3 * cr) END AS cx, CASE WHEN line THEN ly / len ELSE cys / (3 * cr) END AS cy FROM sh),
fk AS (SELECT *, sqrt((cx - 30) * (cx - 30) + (cy - 40) * (cy - 40)) / 1000.0 AS km FROM sg),
fw0 AS (SELECT no, fk.feature_type, area, cx, cy, area * weight * ({PDF}) AS w FROM fk JOIN wt ON wt.feature_type = fk.feature_type),
fw AS (SELECT *, w / sum(w) OVER () AS area_probability FROM fw0)"""


def _weights(spark, d):
    return G.feature_weights(A.features(spark, d), _types(spark), 30.0, 40.0, F.lit(MU), F.lit(SIG))


@query("feature_weights", with_(FT, WT, FW, select="SELECT no AS feature_no, feature_type, round(area, 6) AS area, round(area_probability, 10) AS area_probability FROM fw"))
def _(spark, d):
    return rounded(_weights(spark, d).select("feature_no", "feature_type", "area", "area_probability"), 6, area_probability=10)


@query("polygon_centroid", with_(FT, WT, FW, select="SELECT no AS feature_no, round(cx, 8) AS cx, round(cy, 8) AS cy FROM fw"))
def _(spark, d):
    return rounded(_weights(spark, d).select("feature_no", "cx", "cy"), 8)


U = lambda tag: f"('0x' || substr(md5('13|' || draw || '|{tag}'), 1, 13))::BIGINT / 4503599627370496.0"


@query("polygon_prior", with_(FT, CELL, f"""
big AS (SELECT sum((a.x + b.x) * (a.x * b.y - b.x * a.y)) / (3 * sum(a.x * b.y - b.x * a.y)) AS cx, sum((a.y + b.y) * (a.x * b.y - b.x * a.y)) / (3 * sum(a.x * b.y - b.x * a.y)) AS cy FROM ed WHERE no = (SELECT max(no) FROM ft WHERE NOT line)),
dp0 AS (SELECT "row", col, sqrt((col - cx) * (col - cx) + ("row" - cy) * ("row" - cy)) / 1000.0 AS km, p AS f FROM cell, big),
dp1 AS (SELECT *, {PDF} AS g FROM dp0), dp AS (SELECT *, g / sum(g) OVER () AS d FROM dp1)""", select='SELECT "row", col, round(d * f / sum(d * f) OVER (), 10) AS p FROM dp'))
def _(spark, d):
    f = A.features(spark, d).where("geom_type = 'Polygon'")
    last = f.agg(F.max_by("pts", "feature_no").alias("pts"))
    c = A.cells(spark, d)
    return rounded(R.polygon_prior(c, c, A.grid_spec(spark, d), last, F.lit(MU), F.lit(SIG)).select("row", "col", "p"), 10)


@query("weighted_sample", with_(FT, WT, FW, f"""
tw AS (SELECT feature_type, sum(area_probability) AS w FROM fw GROUP BY 1),
tc AS (SELECT feature_type, (sum(w) OVER (ORDER BY feature_type) - w) / sum(w) OVER () AS lo, sum(w) OVER (ORDER BY feature_type) / sum(w) OVER () AS hi FROM tw),
fc AS (SELECT no, feature_type, (sum(area_probability) OVER o - area_probability) / sum(area_probability) OVER (PARTITION BY feature_type) AS lo, sum(area_probability) OVER o / sum(area_probability) OVER (PARTITION BY feature_type) AS hi FROM fw WINDOW o AS (PARTITION BY feature_type ORDER BY no)),
dr AS (SELECT draw, {U('type')} AS u1, {U('feature')} AS u2, {U('place')} AS u3 FROM range(0, (SELECT count(*) FROM customer)) r(draw)),
pk AS (SELECT draw, u3, fc.no, fc.feature_type FROM dr JOIN tc ON u1 >= tc.lo AND u1 < tc.hi JOIN fc ON fc.feature_type = tc.feature_type AND u2 >= fc.lo AND u2 < fc.hi),
pt AS (SELECT draw, pk.feature_type, feature_id, pts, CAST(floor(u3 * (len(pts) - 1)) AS INT) AS sg, u3 * (len(pts) - 1) - floor(u3 * (len(pts) - 1)) AS fr FROM pk JOIN ft ON ft.no = pk.no)""",
                                  select="SELECT draw, feature_type, feature_id, round(pts[sg + 1].x + fr * (pts[sg + 2].x - pts[sg + 1].x), 7) AS x, round(pts[sg + 1].y + fr * (pts[sg + 2].y - pts[sg + 1].y), 7) AS y FROM pt"))
def _(spark, d):
    n = A.table(spark, d, "customer").count()
    return rounded(G.weighted_sample(_weights(spark, d), n, 13), 7)


@query("nearest_feature", with_(PING, FT, """
sgm AS (SELECT feature_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS l2 FROM ed),
pq AS (SELECT DISTINCT x, y FROM ping),
dd AS (SELECT x, y, feature_id, sqrt(pow(x - (ax + u * (bx - ax)), 2) + pow(y - (ay + u * (by_ - ay)), 2)) AS dist FROM (SELECT x, y, feature_id, ax, ay, bx, by_, greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / l2)) AS u FROM pq, sgm)),
nn AS (SELECT x, y, min(dist) AS dist FROM dd GROUP BY ALL)""", select="SELECT run_id, agent_id, t, round(dist, 6) AS distance FROM ping JOIN nn USING (x, y)"))
def _(spark, d):
    n = G.nearest_feature(A.pings(spark, d), A.features(spark, d), ["run_id", "agent_id", "t"], 1.0, 128.0)
    return rounded(n.select("run_id", "agent_id", "t", "distance"), 6)


@query("flatten_geometries", with_(FT, select="SELECT feature_type, CAST(feature_type || '-' || no // 16 AS VARCHAR) AS feature_id, count(*) AS parts, CAST(sum(len(pts)) AS BIGINT) AS points FROM ft GROUP BY ALL"))
def _(spark, d):
    f = A.features(spark, d).withColumn("gid", F.concat("feature_type", F.lit("-"), F.floor(F.col("feature_no") / 16)))
    multi = f.groupBy(F.col("gid").alias("feature_id"), "feature_type").agg(F.collect_list("pts").alias("parts"))
    return G.flatten_geometries(multi).groupBy("feature_type", "feature_id").agg(F.count("*").alias("parts"), F.sum(F.size("pts")).alias("points"))


@query("common_horizon", with_(RUNS_K, select="""SELECT dataset, planning_seed, k, planning_mode, CAST(max("T") OVER w AS INT) AS "T_common", CAST(max("T") OVER w + 1 AS INT) AS "H_common", round("RMST" / (max("T") OVER w + 1), 9) AS "NRMST" FROM runs WINDOW w AS (PARTITION BY dataset, planning_seed)"""))
def _(spark, d):
    return rounded(X.common_horizon(A.runs(spark, d, True), ["dataset", "planning_seed"]).select("dataset", "planning_seed", "k", "planning_mode", "T_common", "H_common", "NRMST"))
