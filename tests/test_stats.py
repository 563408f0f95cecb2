import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coverlens.functions import dist as D
from coverlens.operators import classify as K
from coverlens.operators import pairing as P
from coverlens.operators import stats as S
from coverlens.operators import summaries as M
from coverlens.operators import validate as V


def frame(spark, values, name="v"):
    return spark.createDataFrame([(1, None if v is None else float(v)) for v in values], f"g int, {name} double")


def test_tails_against_tables():
    assert D.t_ppf(0.975, [1, 2, 10, 100]) == pytest.approx([12.7062, 4.30265, 2.22814, 1.98397], abs=1e-4)
    assert D.chi2_sf([3.841459, 5.991465], [1, 2]) == pytest.approx([0.05, 0.05], abs=1e-6)
    assert D.f_sf(3.492828, 2, 20) == pytest.approx(0.05, abs=1e-6)
    assert D.power_t(0.5, 64, 64, 0.05) == pytest.approx(0.8015, abs=1e-3)


def test_t_interval(spark):
    r = S.mean_ci(frame(spark, [1, 2, 3]), ["g"], "v").first()
    half = D.t_ppf(0.975, 2) / math.sqrt(3)
    assert (r.mean, r.sd) == (2.0, 1.0) and r.ci_hi - 2 == pytest.approx(half)
    one = S.mean_ci(frame(spark, [4]), ["g"], "v").first()
    assert one.mean == 4.0 and one.sd is None and one.ci_lo is None


@pytest.mark.parametrize("values,margin,want", [([0.005] * 5, 0.01, True), ([0.01] * 5, 0.01, False), ([0.02] * 5, 0.01, False), ([0.0], 0.01, False), ([0.001, float("nan")], 0.01, False), ([0.001] * 3, 0.0, False)])
def test_tost_boundaries(spark, values, margin, want):
    assert S.tost(frame(spark, values), ["g"], "v", margin).first().equivalent is want


@pytest.mark.parametrize("values,want", [([0.04, 0.05, 0.06], "IMPROVED"), ([-0.04, -0.05, -0.06], "WORSENED"), ([0.0] * 5, "EQUIVALENT"), ([0.0, 0.2], "INCONCLUSIVE")])
def test_endpoint_classes(spark, values, want):
    s = S.paired_summary(frame(spark, values), ["g"], "v", 0.01)
    assert s.select(K.classify_endpoint(F.col("mean"), F.col("ci_lo"), F.col("ci_hi"), F.col("equivalent"), 0.01).alias("c")).first().c == want


def test_joint_precedence(spark):
    df = spark.createDataFrame([("IMPROVED", "WORSENED"), ("IMPROVED", "EQUIVALENT"), ("EQUIVALENT", "EQUIVALENT"), ("EQUIVALENT", "INCONCLUSIVE")], "a string, b string")
    assert [r.s for r in df.select(K.classify_joint(F.col("a"), F.col("b")).alias("s")).collect()] == ["WORSENING", "IMPROVEMENT", "EQUIVALENT", "INCONCLUSIVE"]


def test_pair_keys(spark):
    rows = spark.createDataFrame([(1, 42, "a"), (1, 42, "a"), (1, 42, "b")], "dataset int, seed int, arm string")
    r = V.pair_status(V.validate_pairs(rows, ["dataset", "seed"], "arm", ["a", "b"])).first()
    assert (r.duplicate_cells, r.incomplete_cells, r.valid) == (1, 1, False)


def test_cluster_bootstrap_repeats(spark):
    df = spark.createDataFrame([(c, float(c - 1)) for c in (1, 2, 3)], "c int, v double").withColumn("g", F.lit(1))
    a = S.cluster_bootstrap(df, ["g"], "c", "v", 400, 7).first()
    assert (a.mean, a.n_clusters) == (1.0, 3) and a == S.cluster_bootstrap(df, ["g"], "c", "v", 400, 7).first()
    assert 0.0 <= a.ci_lo < 1 < a.ci_hi <= 2.0


def test_holm(spark):
    r = S.holm(frame(spark, [0.01, 0.04, 0.03, 0.005], "p"), ["g"], "p").orderBy("p").collect()
    assert [x.p_holm for x in r] == pytest.approx([0.02, 0.03, 0.06, 0.06])


def test_wilcoxon_exact_and_ties(spark):
    r = S.wilcoxon_paired(frame(spark, [1, 2, -3, 4, 5, 6, 7, 8]), ["g"], "v", "exact").first()
    assert (r.w_plus, r.w_minus) == (33.0, 3.0) and r.p == pytest.approx(10 / 256)
    z = S.wilcoxon_paired(frame(spark, [0, 0, 0]), ["g"], "v").first()
    assert z.p == 1.0 and z.rank_biserial == 0.0


def test_cliffs_delta_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 70).astype(float), rng.integers(3, 15, 50).astype(float)
    df = spark.createDataFrame([(1, "a", v) for v in x.tolist()] + [(1, "b", v) for v in y.tolist()], "g int, arm string, v double")
    want = np.sign(x[:, None] - y[None, :]).mean()
    assert S.cliffs_delta(df, ["g"], "arm", "a", "b", "v").first().cliffs_delta == pytest.approx(want)


def test_retention_and_contrasts(spark):
    rows = [(1, 1, 0, "d", 0.5, 10.0, 0.2), (1, 1, 0, "s", 0.5, 10.0, 0.2), (1, 1, 1, "d", 0.4, 12.0, 0.3), (1, 1, 1, "s", 0.3, 14.0, 0.4), (1, 2, 1, "d", 0.3, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "dataset int, planning_seed int, k int, planning_mode string, P_detect double, RMST double, NRMST double").withColumn("H_common", F.lit(20))
    r = P.retention(df, ["dataset", "planning_seed", "planning_mode"], F.col("k") == 0)
    assert r.where("planning_seed = 2").first().retention_invalid_reason == "no_k0_baseline"
    c = P.retention_contrasts(r.where("k > 0 AND planning_seed = 1"), ["dataset", "planning_seed", "k"], "d", "s").first()
    assert c.dRetention_Pdet == pytest.approx(0.2) and c.dDegradation_NRMST == pytest.approx(0.1) and c.dRMST_rel == pytest.approx(0.1)


def test_guards_raise(spark):
    dup = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 1.0)], "dataset int, planning_mode string, m double")
    with pytest.raises(Exception, match="not unique"):
        P.paired_matrix(dup, ["dataset"], "planning_mode", ["a", "b"], "m").collect()
    with pytest.raises(Exception, match="unknown arm"):
        P.code_factors(dup, {"a": (0, 0)}).collect()
    with pytest.raises(Exception, match="one to one"):
        P.join_one_to_one(dup.select("dataset", "m"), dup.select("dataset", "planning_mode"), ["dataset"]).collect()
    runs = dup.selectExpr("dataset", "planning_mode", "m AS P_detect", "m AS RMST", "m AS L", "1 AS H_common")
    with pytest.raises(Exception, match="not unique per arm or lacks one"):
        P.paired_contrasts(runs, ["dataset"], "a", "b").collect()


def test_mixed_model_against_dense_likelihood(spark):
    rng = np.random.default_rng(8)
    n_c, per = 12, 9
    c = np.repeat(np.arange(n_c), per)
    x = np.tile(np.arange(per) % 2, n_c)
    y = 1.0 + 0.5 * x + rng.normal(0, 0.8, n_c)[c] + rng.normal(0, 0.5, n_c * per)
    df = spark.createDataFrame(pd.DataFrame({"c": c, "x": x, "y": y}))
    m = S.mixed_model(df, "c", "y", {"x": F.col("x")}, reml=True).first()
    X = np.column_stack([np.ones_like(x), x]).astype(float)

    def reml(ratio):
        v = np.eye(len(y)) + ratio * (c[:, None] == c[None, :])
        vi = np.linalg.inv(v)
        a = X.T @ vi @ X
        beta = np.linalg.solve(a, X.T @ vi @ y)
        r = y - X @ beta
        dof = len(y) - 2
        s2 = float(r @ vi @ r) / dof
        return -0.5 * (dof * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), beta, s2

    ll, beta, s2 = reml(m.ratio)
    assert m.llf == pytest.approx(ll) and [m.Intercept, m.x] == pytest.approx(beta.tolist()) and m.sigma2 == pytest.approx(s2)
    assert m.llf >= max(reml(m.ratio * f)[0] for f in (0.97, 1.03)) - 1e-9
    assert m.lrt > 3 and 0 < m.icc < 1


def test_study_report_unpaired_and_levene(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, a, float(v)) for a, s in (("a", 1.0), ("b", 1.0), ("c", 4.0)) for i, v in enumerate(rng.normal(0, s, 80))], "id int, arm string, v double")
    r = {x.arm: x for x in M.study_report(df, ["id"], "arm", ["a", "b", "c"], "a", "v", paired=False).collect()}
    assert r["a"].p is None and r["b"].p_holm >= r["b"].p
    assert S.levene(df.withColumn("g", F.lit(1)), ["g"], "arm", "v").first().p < 1e-6
