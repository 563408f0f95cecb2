"""Belief maps: per-cell evidence with recovery, posteriors and their diagnostics.

A posterior is kept sparse: one row per touched cell plus one background row (row = col = -1) that holds the mass of all
untouched cells, each of which keeps its prior divided by the same normaliser.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.operators.grid import GridSpec, footprint
from coverlens.operators.recurrence import settled_belief
from coverlens.operators.scan import on_keys, with_totals

CELL = ["run_id", "row", "col"]


def observations(events: DataFrame, union_per_step: bool = True, detected: DataFrame | None = None) -> DataFrame:
    """(run, row, col, t, k): one factor per step, or one per agent and step (k of them).

    A look that finds its target is no evidence of absence: cells in ``detected`` (run, row, col, t) are skipped at their step."""
    if detected is not None:
        events = events.join(detected.select(*CELL, "t").distinct(), [*CELL, "t"], "left_anti")
    g = events.groupBy(*CELL, "t").agg(F.count("*").alias("k"))
    return g.withColumn("k", F.lit(1).cast("bigint")) if union_per_step else g


def _has_recovery(tau: float) -> bool:
    return tau > 0 and not math.isinf(tau)


def _recover(ell: Column, elapsed: Column, tau: float) -> Column:
    if not _has_recovery(tau):
        return ell
    return 1.0 - (1.0 - ell) * F.exp(-F.greatest(elapsed, F.lit(0)) / F.lit(float(tau)))


def _fold(seq: Column, p_d: float, tau: float) -> Column:
    start = F.struct(F.lit(1.0).alias("ell"), F.lit(0).cast("int").alias("t"))
    step = lambda s, o: F.struct((_recover(s["ell"], o["t"] - s["t"], tau) * F.pow(F.lit(1.0 - p_d), o["k"])).alias("ell"), o["t"].alias("t"))
    return F.aggregate(seq, start, step)


def _histories(obs: DataFrame) -> DataFrame:
    """Sorted observation steps per cell; at most one entry per step of the horizon."""
    return obs.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("t", "k"))).alias("_h"))


def evidence_weights(obs: DataFrame, p_d: float, tau: float, at: Column | None = None) -> DataFrame:
    """Evidence weight per touched cell right after its last observation, or recovered to the time ``at``."""
    h = _histories(obs).withColumn("_s", _fold(F.col("_h"), p_d, tau))
    ell = F.col("_s.ell") if at is None else _recover(F.col("_s.ell"), at - F.col("_s.t"), tau)
    return h.select(*CELL, ell.alias("ell"), F.col("_s.t").alias("last_t"))


def posterior(weights: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """prior * ell / Z per touched cell plus the background row."""
    keys = list(keys)
    mass = cells.agg(F.sum("p")).scalar()
    j = weights.join(cells.select("row", "col", "p"), ["row", "col"]).withColumn("_u", F.col("p") * F.col("ell"))
    z = j.groupBy(*keys).agg(F.sum("p").alias("_p"), F.sum("_u").alias("_us")).select(
        *keys, (mass - F.col("_p")).alias("_bg"), (mass - F.col("_p") + F.col("_us")).alias("_z"))
    share = lambda u: F.when(F.col("_z") > 0, u / F.col("_z")).otherwise(u)
    touched = on_keys(j, z, keys).select(*keys, "row", "col", share(F.col("_u")).alias("posterior"))
    bg = z.select(*keys, F.lit(-1).alias("row"), F.lit(-1).alias("col"), share(F.col("_bg")).alias("posterior"))
    return touched.unionByName(bg)


def posterior_at(obs: DataFrame, cells: DataFrame, p_d: float, tau: float, times: list[int]) -> DataFrame:
    """Posterior series at the given times (a short list): the fold of each cell stops at each time."""
    h = _histories(obs).withColumn("time", F.explode(F.array(*[F.lit(t) for t in times])))
    h = h.withColumn("_h", F.filter("_h", lambda o: o["t"] <= F.col("time"))).where(F.size("_h") > 0)
    s = h.withColumn("_s", _fold(F.col("_h"), p_d, tau))
    w = s.select(*CELL, "time", _recover(F.col("_s.ell"), F.col("time") - F.col("_s.t"), tau).alias("ell"))
    return posterior(w, cells, ("run_id", "time"))


def mass_conserving_belief(obs: DataFrame, cells: DataFrame, p_d: float, tau: float, end: int, time_zero: bool = True) -> DataFrame:
    """Belief after step ``end`` that is brought back to its own mass at every step.

    Without recovery this is the evidence posterior times the total mass, with it the recurrence of ``recurrence.settled_belief``."""
    if _has_recovery(tau):
        return settled_belief(obs, cells, p_d, tau, end, time_zero)
    mass = cells.agg(F.sum("p")).scalar()
    return posterior(evidence_weights(obs.where(F.col("t") <= end), p_d, tau), cells).withColumn("posterior", F.col("posterior") * mass)


def belief_stats(obs: DataFrame, weights: DataFrame, cells: DataFrame) -> DataFrame:
    """Updates, cells observed, prior and reduced mass, reduction factor."""
    mass = cells.agg(F.sum("p")).scalar()
    c = obs.groupBy("run_id", "t").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count("*").alias("num_updates"), F.sum("n").alias("total_cells_observed"))
    w = weights.join(cells.select("row", "col", "p"), ["row", "col"]).groupBy("run_id").agg(
        F.count("*").alias("cells_ever_observed"), F.sum(F.col("p") * (1.0 - F.col("ell"))).alias("_lost"))
    j = on_keys(c, w, ["run_id"])
    return j.select("run_id", "num_updates", "total_cells_observed", "cells_ever_observed", mass.alias("prior_sum"), (mass - F.col("_lost")).alias("evidence_sum"),
                    ((mass - F.col("_lost")) / mass).alias("reduction_factor"))


def grid_entropy(cells: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    p = F.col(value)
    return cells.groupBy(*keys).agg(F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("entropy"), F.max(p).alias("peak"), F.count_if(p > 0).alias("support"))


def total_variation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Half the summed absolute difference per common (run, time), with the last and the largest per run."""
    a = left.select("run_id", "time", "row", "col", F.col("posterior").alias("pa"))
    b = right.select("run_id", "time", "row", "col", F.col("posterior").alias("pb"))
    common = a.select("run_id", "time").distinct().join(b.select("run_id", "time").distinct(), ["run_id", "time"])
    j = a.join(b, ["run_id", "time", "row", "col"], "full").join(common, ["run_id", "time"], "left_semi")
    tv = j.groupBy("run_id", "time").agg((0.5 * F.sum(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))))).alias("tv"))
    return tv.groupBy("run_id").agg(F.max_by("tv", "time").alias("tv_last"), F.max("tv").alias("tv_max"), F.count("*").alias("snapshots"))


def _weighted(cells: DataFrame, observed: DataFrame, revisit_weight: float) -> DataFrame:
    seen = observed.select("row", "col").distinct().withColumn("_seen", F.lit(True))
    return cells.select("row", "col", "p").join(seen, ["row", "col"], "left").select(
        "row", "col", F.when(F.col("_seen"), F.col("p") * revisit_weight).otherwise(F.col("p")).alias("_v"))


def position_score(positions: DataFrame, cells: DataFrame, observed: DataFrame, grid: GridSpec, radius: float, revisit_weight: float, keys: list[str]) -> DataFrame:
    """New mass plus weighted already-seen mass in the footprint of a position."""
    f = footprint(positions, grid, radius).select(*keys, "row", "col").join(_weighted(cells, observed, revisit_weight), ["row", "col"])
    return f.groupBy(*keys).agg(F.sum("_v").alias("score"))


def path_reward(positions: DataFrame, cells: DataFrame, observed: DataFrame, grid: GridSpec, radius: float, revisit_weight: float, keys: list[str]) -> DataFrame:
    """The same over a candidate path, each cell once."""
    f = footprint(positions, grid, radius).select(*keys, "row", "col").distinct().join(_weighted(cells, observed, revisit_weight), ["row", "col"])
    return f.groupBy(*keys).agg(F.sum("_v").alias("reward"), F.count("*").alias("cells"))
