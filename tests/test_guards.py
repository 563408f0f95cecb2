"""Operators that must fail loudly, whatever columns are read, and draws that must be complete."""

import pytest
from pyspark.sql import functions as F

from coverlens.operators import exposure as X
from coverlens.operators import pairing as P
from coverlens.operators import stats as S
from coverlens.operators import validate as V
from coverlens.session import checkpoint_dir

RUN = "trial int, planning_mode string, P_detect double, RMST double, L double, H_common int"


def runs(spark, *rows):
    return spark.createDataFrame([(t, a, p, 2.0, 3.0, 51) for t, a, p in rows], RUN)


@pytest.mark.parametrize("column", ["dPdet", "dRMST_rel", "dL"])
def test_paired_contrasts_raise_in_every_column(spark, column):
    for rows in ([(1, "A", 0.1), (1, "A", 0.2), (1, "R", 0.3)], [(1, "A", 0.1)]):
        with pytest.raises(Exception, match="not unique per arm or lacks one"):
            P.paired_contrasts(runs(spark, *rows), ["trial"], "A", "R").select(column).collect()


def test_paired_diff_raises_on_repeats(spark):
    with pytest.raises(Exception, match="not unique"):
        P.paired_diff(runs(spark, (1, "A", 1.0), (1, "A", 2.0), (1, "R", 3.0)), ["trial"], "dPdet", "R", "A").collect()


@pytest.mark.parametrize("column", ["dynamism", "horizon"])
def test_code_factors_raise_in_every_column(spark, column):
    df = spark.createDataFrame([("odd",)], "planning_mode string")
    with pytest.raises(Exception, match="unknown arm"):
        P.code_factors(df, {"static": (0, 1)}).select(column).collect()


def test_arm_pairs_require_raises_when_one_column_is_read(spark):
    with pytest.raises(Exception, match="missing arm"):
        P.arm_pairs(runs(spark, (1, "A", 0.1)), ["trial"], "planning_mode", [("A", "R")], ["L"], require=True).select("trial").collect()


def test_friedman_blocks(spark):
    arms = ["A", "B", "R"]
    good = [(b, a, float(v)) for b, vs in enumerate([(1, 2, 3), (2, 4, 6), (1, 5, 9)]) for a, v in zip(arms, vs)]
    df = spark.createDataFrame([*good, (7, "A", 1.0), (7, "R", 2.0)], "b int, a string, v double")
    r = S.friedman(df, [], ["b"], "a", "v", arms).first()
    assert (r.n_complete, r.chi2) == (3, pytest.approx(6.0))
    with pytest.raises(Exception, match="repeats an arm"):
        S.friedman(df.union(spark.createDataFrame([(7, "A", 1.0)], df.schema)), [], ["b"], "a", "v", arms).collect()


def test_exact_signed_ranks(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (-2.0,)], "v double").withColumn("g", F.lit(1))
    r = S.wilcoxon_paired(df, ["g"], "v", "exact").first()
    assert (r.statistic, r.p, r.method) == (3.0, 1.0, "exact")
    with pytest.raises(ValueError):
        S.wilcoxon_paired(df, ["g"], "v", "auto")


def test_poisson_table_is_complete():
    assert 1 - S.POISSON_CUM[-1] < 2**-52


def test_scratch_folder_needs_a_shared_one_off_local_masters():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_pre_event_identity_raises_on_a_repeated_arm(spark):
    once = [(1, "A", 0.1), (1, "R", 0.1)]
    check = lambda rows: V.pre_event_identity(runs(spark, *rows), ["trial"], "planning_mode", "A", "R", "P_detect", ["H_common"]).first()
    assert check(once).value_all_equal and check(once).H_common_all_equal
    with pytest.raises(Exception, match="not unique"):
        check([*once, (1, "A", 0.05)])


def test_runs_that_find_nothing_have_their_rows(spark):
    pings = spark.createDataFrame([("r", 0, t, float(t), 0.0) for t in range(4)] + [("far", 0, t, 90.0 + t, 90.0) for t in range(4)], "run_id string, agent_id int, t int, x double, y double")
    targets = spark.createDataFrame([(1, 1.0, 0.5), (2, 50.0, 50.0)], "target_id int, x double, y double")
    found = X.targets_found(pings, targets, 1.0)
    assert {(r.run_id, r.found, r.percentage_found) for r in X.found_percentage(found, targets, pings).collect()} == {("r", 1, 50.0), ("far", 0, 0.0)}
    assert {(r.run_id, r.found, r.percentage_found) for r in X.found_percentage(found.limit(0), targets.limit(0), pings).collect()} == {("r", 0, 0.0), ("far", 0, 0.0)}
    tracks = spark.createDataFrame([(1, t, 1.0, 0.0) for t in range(4)], "target_id int, t int, x double, y double")
    pairs = spark.createDataFrame([("r", 1), ("far", 1)], "run_id string, target_id int")
    rows = {r.run_id: r for r in X.moving_target_detection(pings, tracks, 0.5, 0.8, F.lit(3), pairs=pairs).collect()}
    assert (rows["far"].exposures, rows["far"].P_detect, rows["far"].RMST, rows["far"].T_detect_realized, rows["far"].detected) == (0, 0.0, 4.0, 4, False)
    assert rows["r"].exposures == 1 and abs(rows["r"].P_detect - 0.8) < 1e-12 and abs(rows["r"].RMST - (1 + 3 * 0.2)) < 1e-12


def test_attrition_gate_fails_a_missing_level(spark):
    from coverlens.operators import classify as K

    rows = [(c, k, "EQUIVALENT" if c != "og" else "IMPROVEMENT") for c in ("geo", "on", "og") for k in (1, 2, 3, 4)]
    gate = lambda r: K.attrition_gate(spark.createDataFrame(r, "comparator string, k int, state string"), "k", "comparator", "geo", "on", "og").first()
    assert gate(rows).gate == "PIZZA_GAP_CLOSED"
    some = [r for r in rows if r[:2] != ("geo", 4)]
    assert gate(some).gate == "ONLINE_REPLANNING_MAIN" and not gate(some).geometric_equivalent
    assert gate([r for r in some if r[:2] != ("og", 2)]).gate == "NO_DIFFERENTIAL_ADVANTAGE"
