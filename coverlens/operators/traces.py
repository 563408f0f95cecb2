"""Decision-trace analytics over JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlens.operators.grid import EIGHT, spread
from coverlens.operators.quantiles import exact_quantiles
from coverlens.operators.scan import on_keys
from coverlens.schemas import TRACE_ITEM


def trace_items(df: DataFrame, keys: list[str], column: str = "trace_json") -> DataFrame:
    """Trace JSON to one row per item; unreadable text yields nothing."""
    items = F.from_json(column, T.ArrayType(TRACE_ITEM), {"mode": "PERMISSIVE"})
    return df.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.*")


def explode_trace(df: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions with their regret, relative regret and tie flag; items without an optimum are skipped."""
    i = trace_items(df, keys).where("exact_optimal_reward IS NOT NULL")
    opt, got = F.col("exact_optimal_reward"), F.col("exact_bellman_action_reward")
    return i.select(
        *keys, "seq", "replan_id", "drone", F.coalesce("action_agreement", F.lit(False)).alias("action_agreement"),
        (F.abs(got - opt) <= 1e-8 + 1e-5 * F.abs(opt)).alias("agreement_ties"), (opt - got).alias("exact_regret"),
        F.when(opt > 0, (opt - got) / opt).alias("relative_regret"), opt.alias("exact_optimal_reward"), got.alias("exact_bellman_action_reward"))


def trace_means(df: DataFrame, keys: list[str]) -> DataFrame:
    i = trace_items(df, keys)
    return i.groupBy(*keys).agg(
        F.avg(F.col("action_agreement").cast("int")).alias("action_agreement"), F.avg("exact_regret").alias("exact_regret"),
        F.count("action_agreement").alias("n_decisions"), F.avg("exact_reward").alias("tree_exact_reward"))


def regret_summary(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, exact tail quantiles and maximum of the regret, absolute and relative."""
    m = decisions.groupBy(*keys).agg(
        F.avg(F.col("action_agreement").cast("int")).alias("action_agreement"), F.avg(F.col("agreement_ties").cast("int")).alias("agreement_ties"),
        F.avg("exact_regret").alias("mean_exact_regret"), F.max("exact_regret").alias("regret_max"), F.avg("relative_regret").alias("mean_relative_regret"),
        F.count("*").alias("n_decisions"))
    q = exact_quantiles(decisions, keys, "exact_regret", {"regret_p90": 0.9, "regret_p95": 0.95, "regret_p99": 0.99})
    r = exact_quantiles(decisions, keys, "relative_regret", {"relative_p90": 0.9, "relative_p95": 0.95, "relative_p99": 0.99})
    return on_keys(on_keys(m, q, keys), r, keys, "left")


def _last_actions(items: DataFrame) -> DataFrame:
    return items.groupBy("replan_id", "drone").agg(F.max_by(F.struct("target_row", "target_col"), "seq").alias("a"))


def action_disagreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Share of common (replan, agent) keys with different targets; null share when nothing is common."""
    j = _last_actions(left).join(_last_actions(right).withColumnRenamed("a", "b"), ["replan_id", "drone"])
    return j.agg(F.avg((F.col("a") != F.col("b")).cast("int")).alias("disagreement"), F.count("*").alias("comparable"))


def duplicate_targets(items: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicated target decisions and the share of planning cycles that have any."""
    t = items.groupBy(*keys, "replan_id", "target_row", "target_col").agg((F.count("*") - 1).alias("x"))
    c = t.groupBy(*keys, "replan_id").agg(F.sum("x").alias("x"))
    return c.groupBy(*keys).agg(F.sum("x").alias("duplicates"), F.avg((F.col("x") > 0).cast("int")).alias("duplicate_cycle_fraction"))


def invalid_actions(items: DataFrame, valid_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Actions to a cell that is no valid neighbour of the start, and holds (staying where no neighbour is valid)."""
    v = valid_cells.select("row", "col").distinct()
    degree = spread(v, EIGHT).groupBy("row", "col").agg(F.count("*").alias("_n")).select(F.col("row").alias("start_row"), F.col("col").alias("start_col"), "_n")
    ok = v.select(F.col("row").alias("target_row"), F.col("col").alias("target_col"), F.lit(True).alias("_ok"))
    j = items.join(ok, ["target_row", "target_col"], "left").join(degree, ["start_row", "start_col"], "left")
    dr, dc = F.abs(F.col("target_row") - F.col("start_row")), F.abs(F.col("target_col") - F.col("start_col"))
    stay = (dr == 0) & (dc == 0)
    hold = stay & (F.coalesce("_n", F.lit(0)) == 0)
    fine = ~stay & (dr <= 1) & (dc <= 1) & F.coalesce("_ok", F.lit(False))
    return j.groupBy(*keys).agg(F.count_if(~hold & ~fine).alias("invalid"), F.count_if(hold).alias("holds"), F.count("*").alias("actions"))


def flatten_diag(df: DataFrame, keys: list[str], maps: dict[str, str], lists: dict[str, str]) -> DataFrame:
    """JSON map columns to the sum, maximum and mean of their values, JSON list columns to their length."""
    out: list[Column] = []
    for name, c in maps.items():
        vals = F.map_values(F.from_json(c, T.MapType(T.StringType(), T.DoubleType())))
        total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
        out += [total.alias(f"{name}_total"), F.array_max(vals).alias(f"{name}_max"), F.try_divide(total, F.size(vals)).alias(f"{name}_mean")]
    for name, c in lists.items():
        out.append(F.size(F.from_json(c, T.ArrayType(T.StringType()))).alias(f"{name}_count"))
    return df.select(*keys, *out)


def first_actions(items: DataFrame, keys: list[str]) -> DataFrame:
    g = items.groupBy(*keys, "drone").agg(F.min_by(F.struct("target_row", "target_col"), "seq").alias("a"))
    return g.select(*keys, "drone", "a.target_row", "a.target_col")
