"""Exposure and detection aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.functions.hashing import uniform
from coverlens.operators.geometry import PATH, dist, edges, resample_path, segment_distance, with_distance, with_steps
from coverlens.operators.grid import GridSpec, footprint
from coverlens.operators.scan import on_keys, running_sums, with_totals
from coverlens.session import cut_lineage

CELL = ["run_id", "row", "col"]


def exposure_events(pings: DataFrame, grid: GridSpec, radius: float) -> DataFrame:
    """(run, agent, row, col, t): one row per agent, step and visible cell."""
    return footprint(pings, grid, radius).select("run_id", "agent_id", "row", "col", "t")


def exposure_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(*CELL).agg(F.count("*").alias("n"))


def _detected(p_d: float, n: Column) -> Column:
    return 1.0 - F.pow(F.lit(1.0 - p_d), n)


def every_run(found: DataFrame, runs: DataFrame | None, *zero: str) -> DataFrame:
    """Also the runs that saw nothing: one row per run of ``runs``, the named columns 0 and the others null. Unchanged without ``runs``."""
    if runs is None:
        return found
    out = runs.select("run_id").distinct().join(found, "run_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)) for c in zero})


def expected_detection(counts: DataFrame, cells: DataFrame, p_d: float, runs: DataFrame | None = None) -> DataFrame:
    j = counts.join(cells.select("row", "col", "p"), ["row", "col"])
    return every_run(j.groupBy("run_id").agg(F.sum(F.col("p") * _detected(p_d, F.col("n"))).alias("P_detect")), runs, "P_detect")


def coverage(events: DataFrame, cells: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    seen = events.select(*CELL).distinct().join(cells.select("row", "col", "p"), ["row", "col"])
    return every_run(seen.groupBy("run_id").agg(F.sum("p").alias("L"), F.count("*").alias("observed_cells")), runs, "L", "observed_cells")


def exposure_stats(counts: DataFrame, n_valid: Column | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Totals, revisit share, multiplicity, maximum and (given the domain size) the new-coverage share; shares of nothing are null."""
    total, unique = F.sum("n"), F.count("*")
    out = [total.alias("total"), unique.alias("observed_cells"), F.max("n").alias("max_n"),
           ((total - unique) / total).alias("revisit_fraction"), (total / unique).alias("exposure_multiplicity")]
    g = every_run(counts.groupBy("run_id").agg(*out), runs, "total", "observed_cells", "max_n")
    return g if n_valid is None else g.withColumn("new_coverage_fraction", F.col("observed_cells") / n_valid)


def step_counts(events: DataFrame) -> DataFrame:
    """Exposures per (run, cell, t); after this a cell holds at most one row per time step, however hot it is."""
    return events.groupBy(*CELL, "t").agg(F.count("*").alias("k"))


def cell_survival(steps: DataFrame, p_d: float, horizon: Column) -> DataFrame:
    """Per cell: exposures ``n`` and restricted mean survival, from run lengths between exposure times.

    The window holds one row per time step of one cell, so its size is bounded by the horizon.
    """
    q = F.lit(1.0 - p_d)
    s = steps.withColumn("_T", horizon).where("t <= _T")
    w = Window.partitionBy(*CELL).orderBy("t")
    cum = F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.lead("t", 1).over(w)
    r = s.select(*CELL, "t", "k", F.pow(q, cum).alias("_s"), (F.coalesce(nxt, F.col("_T") + 1) - F.col("t")).alias("_len"))
    return r.groupBy(*CELL).agg(F.sum("k").alias("n"), (F.min("t") + F.sum(F.col("_s") * F.col("_len"))).alias("rmst"))


def mission_endpoints(pings: DataFrame, cells: DataFrame, grid: GridSpec, radius: float, p_d: float,
                      horizon: Column | None = None, t_max: int | None = None) -> DataFrame:
    """All stationary endpoints per run from one footprint: P_detect, RMST, L, exposure totals.

    ``horizon`` is the last step of the common horizon; by default the last step over all runs. ``t_max`` truncates the paths and fixes
    the horizon there. Untouched mass survives the whole horizon: a run that sees nothing detects nothing and survives it all.
    """
    runs = pings
    if t_max is not None:
        pings, horizon = pings.where(F.col("t") <= t_max), F.lit(t_max)
    elif horizon is None:
        horizon = pings.agg(F.max("t")).scalar()
    per_cell = cell_survival(step_counts(exposure_events(pings, grid, radius)), p_d, horizon)
    j = per_cell.join(cells.select("row", "col", "p"), ["row", "col"])
    g = j.groupBy("run_id").agg(
        F.sum(F.col("p") * _detected(p_d, F.col("n"))).alias("P_detect"), F.sum(F.col("p") * F.col("rmst")).alias("_r"), F.sum("p").alias("L"),
        F.sum("n").alias("exposures"), F.count("*").alias("observed_cells"), F.max("n").alias("max_n"))
    g = every_run(g, runs, "P_detect", "_r", "L", "exposures", "observed_cells", "max_n")
    mass = cells.agg(F.sum("p")).scalar()
    return g.select(
        "run_id", "P_detect", (F.col("_r") + (mass - F.col("L")) * (horizon + 1)).alias("RMST"), "L", "exposures", "observed_cells", "max_n",
        F.try_divide("exposures", "observed_cells").alias("exposure_multiplicity"),
        F.try_divide(F.col("exposures") - F.col("observed_cells"), "exposures").alias("revisit_fraction"))


def expected_rmst(events: DataFrame, cells: DataFrame, p_d: float, horizon: Column, runs: DataFrame | None = None) -> DataFrame:
    per_cell = cell_survival(step_counts(events), p_d, horizon).join(cells.select("row", "col", "p"), ["row", "col"])
    mass = cells.agg(F.sum("p")).scalar()
    g = every_run(per_cell.groupBy("run_id").agg(F.sum(F.col("p") * F.col("rmst")).alias("_r"), F.sum("p").alias("_l")), runs, "_r", "_l")
    return g.select("run_id", (F.col("_r") + (mass - F.col("_l")) * (horizon + 1)).alias("RMST"))


def common_horizon(runs: DataFrame, job: list[str]) -> DataFrame:
    """T_common = max T over the arms of a job, H_common = T_common + 1, NRMST = RMST / H_common."""
    r = with_totals(runs.drop("T_common", "H_common"), job, {"T_common": F.max("T")}).withColumn("H_common", F.col("T_common") + 1)
    return r.withColumn("NRMST", F.col("RMST") / F.col("H_common"))


def discounted_score(samples: DataFrame, cells: DataFrame, grid: GridSpec, radius: float, gamma: float, lengths: DataFrame) -> DataFrame:
    """Sum over samples and visible cells of p * gamma^(distance); revisits count and distance continues across a run's paths.

    ``lengths`` has one row per path: (run_id, agent_id, length); paths follow each other in agent order.
    """
    offs = running_sums(lengths, ["run_id"], "agent_id", {"_end": F.col("length")})
    offs = offs.select("run_id", "agent_id", (F.col("_end") - F.col("length")).alias("_off"))
    s = on_keys(samples, offs, PATH).withColumn("_g", F.col("distance") + F.col("_off"))
    f = footprint(s, grid, radius).join(cells.select("row", "col", "p"), ["row", "col"])
    return f.groupBy("run_id").agg(F.sum(F.col("p") * F.pow(F.lit(gamma), F.col("_g"))).alias("discounted_score"))


def cumulative_coverage(pings: DataFrame, cells: DataFrame, grid: GridSpec, radius: float, gamma: float) -> DataFrame:
    """Per path and step: running mass (each cell once per path) and its running value discounted by path distance."""
    d = with_distance(pings).select(*PATH, "t", "x", "y", "cum")
    f = footprint(d, grid, radius)
    first = f.groupBy(*PATH, "row", "col").agg(F.min("t").alias("t"))
    mass = first.join(cells.select("row", "col", "p"), ["row", "col"]).groupBy(*PATH, "t").agg(F.sum("p").alias("_p"))
    j = on_keys(d.select(*PATH, "t", "cum"), mass, PATH + ["t"], "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    return running_sums(j, PATH, "t", {"likelihood": F.col("_p"), "discounted": F.col("_p") * F.pow(F.lit(gamma), F.col("cum"))}).drop("_p")


def path_length_km(pings: DataFrame) -> DataFrame:
    return with_steps(pings).groupBy("run_id").agg((F.sum("step") / 1000.0).alias("length_km"))


def area_covered(events: DataFrame, grid: GridSpec) -> DataFrame:
    """Distinct footprint cells times cell area in km2 (tends to the buffered-union area as cells shrink)."""
    seen = events.select(*CELL).distinct()
    return seen.groupBy("run_id").agg((F.count("*") * (grid.dx * grid.dy) / 1_000_000.0).alias("area_km2"))


def segments(pings: DataFrame) -> DataFrame:
    return with_steps(pings).where("prev_x IS NOT NULL AND step > 0").select(
        "run_id", F.col("prev_x").alias("ax"), F.col("prev_y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))


def _reach(s: DataFrame, radius: float, size: float) -> DataFrame:
    """Each segment in every bucket (gx, gy) that holds a point within ``radius`` of it."""
    cell = lambda c: F.floor(c / size)
    s = s.withColumn("gy", F.explode(F.sequence(cell(F.least("ay", "by") - radius), cell(F.greatest("ay", "by") + radius))))
    # x range of the part of the segment inside the bucket row, widened by the radius
    lo_y, hi_y = F.col("gy") * size - radius, (F.col("gy") + 1) * size + radius
    at = lambda y: F.col("ax") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(y - F.col("ay"), F.col("by") - F.col("ay")))) * (F.col("bx") - F.col("ax"))
    flat = F.col("ay") == F.col("by")
    xa = F.when(flat, F.col("ax")).otherwise(at(lo_y))
    xb = F.when(flat, F.col("bx")).otherwise(at(hi_y))
    return s.withColumn("gx", F.explode(F.sequence(cell(F.least(xa, xb) - radius), cell(F.greatest(xa, xb) + radius))))


#: Rounds of the target search and the factor by which the segments looked at grow from one to the next.
FIND_ROUNDS, FIND_GROWTH = 5, 8


def targets_found(pings: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(run_id, target_id) pairs where the target lies within ``radius`` of the run's path.

    A bucket equi-join of places and segments, in rounds: one segment decides a pair, so each round looks at a larger share of the segments
    for the places still open, and the last at all that are left. Where many segments cross a place few are ever looked at for it; segments
    without an open place in reach are not sent. Targets at one place are one place, and a run's equal segments are one.
    """
    size = max(radius, 1.0) * 4
    cell = lambda c: F.floor(c / size)
    t = targets.select("target_id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    s = cut_lineage(segments(pings).distinct().withColumn("_h", F.pmod(F.xxhash64("run_id", "ax", "ay", "bx", "by"), F.lit(FIND_GROWTH ** (FIND_ROUNDS - 1)))))
    places = t.groupBy("x", "y").agg(F.count("*").alias("_n")).drop("_n")
    box = s.groupBy("run_id").agg(*[f(g(a, b)).alias(n) for n, f, g, a, b in (("_x0", F.min, F.least, "ax", "bx"), ("_x1", F.max, F.greatest, "ax", "bx"), ("_y0", F.min, F.least, "ay", "by"), ("_y1", F.max, F.greatest, "ay", "by"))])
    inside = F.col("x").between(F.col("_x0") - radius, F.col("_x1") + radius) & F.col("y").between(F.col("_y0") - radius, F.col("_y1") + radius)
    open_ = places.join(box, inside).select("run_id", "x", "y", cell(F.col("x")).alias("gx"), cell(F.col("y")).alias("gy"))
    found, low = None, 0
    for i in range(FIND_ROUNDS):
        high = FIND_GROWTH**i
        part = _reach(s.where((F.col("_h") >= low) & (F.col("_h") < high)), radius, size)
        part = part.join(open_.select("run_id", "gx", "gy").distinct(), ["run_id", "gx", "gy"], "left_semi")
        near = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= radius
        hit = open_.join(part, ["run_id", "gx", "gy"]).where(near).groupBy("run_id", "x", "y").agg(F.count("*").alias("_n")).drop("_n")
        hit = cut_lineage(hit)
        found = hit if found is None else found.unionByName(hit)
        if i + 1 < FIND_ROUNDS:
            open_ = cut_lineage(open_.join(hit, ["run_id", "x", "y"], "left_anti"))
        low = high
    return t.join(found, ["x", "y"]).groupBy("run_id", "target_id").agg(F.count("*").alias("_n")).select("run_id", "target_id")


def found_percentage(found: DataFrame, targets: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Targets found by each run and their share; with ``runs``, 0 for runs that find none, and for all of them where there is no target."""
    n = targets.agg(F.count("*")).scalar()
    g = found.groupBy("run_id").agg(F.count("*").alias("found")).withColumn("percentage_found", F.coalesce(F.try_divide(F.col("found") * 100.0, n), F.lit(0.0)))
    return every_run(g, runs, "found", "percentage_found")


def view_score(positions: DataFrame, cells: DataFrame, visited: DataFrame, grid: GridSpec, radius: float, keys: list[str]) -> DataFrame:
    """Mass of the visible cells not yet visited."""
    fresh = cells.select("row", "col", "p").join(visited.select("row", "col").distinct(), ["row", "col"], "left_anti")
    f = footprint(positions, grid, radius).join(fresh, ["row", "col"])
    got = f.groupBy(*keys).agg(F.sum("p").alias("_s"))
    out = on_keys(positions.select(*keys), got, keys, "left")
    return out.select(*keys, F.coalesce("_s", F.lit(0.0)).alias("view_score"))


def _by_interval(first: DataFrame, cells: DataFrame, last: DataFrame, step: float) -> DataFrame:
    """Running first-seen mass per run on the grid 0, step, 2 step, ... ; ``first`` has (run_id, row, col, at)."""
    i = F.ceil(F.col("at") / step).cast("int")
    mass = first.join(cells.select("row", "col", "p"), ["row", "col"]).groupBy("run_id", i.alias("interval")).agg(
        F.sum("p").alias("_p"), F.count("*").alias("_c"))
    dense = last.select("run_id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("last") / step).cast("int"))).alias("interval"))
    j = on_keys(dense, mass, ["run_id", "interval"], "left").fillna(0)
    return running_sums(j, ["run_id"], "interval", {"likelihood": F.col("_p"), "cells": F.col("_c")}).drop("_p", "_c")


def metrics_by_distance(pings: DataFrame, cells: DataFrame, grid: GridSpec, radius: float, interval: float) -> DataFrame:
    """Likelihood and covered cells of every prefix of i * interval of path length (all agents of a run together)."""
    d = with_distance(pings)
    f = footprint(d.select("run_id", "x", "y", "cum"), grid, radius)
    first = f.groupBy(*CELL).agg(F.min("cum").alias("at"))
    last = d.groupBy("run_id").agg(F.max("cum").alias("last"))
    out = _by_interval(first, cells, last, interval)
    return out.withColumns({"distance": F.col("interval") * interval, "area_km2": F.col("cells") * (grid.dx * grid.dy) / 1_000_000.0})


def metrics_by_index(pings: DataFrame, cells: DataFrame, grid: GridSpec, radius: float, every: int) -> DataFrame:
    """The same by vertex index inside each path, with the mean path distance at each interval."""
    d = with_distance(pings)
    d = running_sums(d, PATH, "t", {"idx": F.lit(1)}).withColumn("idx", F.col("idx") - 1).select("run_id", "agent_id", "t", "x", "y", "cum", "idx")
    first = footprint(d, grid, radius).groupBy(*CELL).agg(F.min("idx").alias("at"))
    ends = d.groupBy(*PATH).agg(F.max("idx").alias("end"), F.max("cum").alias("len"))
    last = ends.groupBy("run_id").agg(F.max("end").alias("last"), F.count("*").alias("agents"), F.sum("len").alias("all_len"))
    out = _by_interval(first, cells, last, every)
    # distance gained by each agent up to index i*every, as increments booked on the first interval that includes them
    steps = with_steps(d, PATH)
    inc = steps.groupBy("run_id", F.ceil(F.col("idx") / every).cast("int").alias("interval")).agg(F.sum("step").alias("_d"))
    j = on_keys(out, inc, ["run_id", "interval"], "left").withColumn("_d", F.coalesce("_d", F.lit(0.0)))
    j = running_sums(j, ["run_id"], "interval", {"_dist": F.col("_d")})
    return on_keys(j, last.select("run_id", "agents"), ["run_id"]).select(
        "run_id", "interval", "likelihood", "cells", (F.col("_dist") / F.col("agents")).alias("mean_distance"))


def first_crossing(pings: DataFrame, threshold: float) -> DataFrame:
    """First step at which a run's fleet distance reaches the threshold."""
    s = with_steps(pings).groupBy("run_id", "t").agg(F.sum("step").alias("_d"))
    r = running_sums(s, ["run_id"], "t", {"distance": F.col("_d")})
    return r.where(F.col("distance") >= threshold).groupBy("run_id").agg(F.min(F.struct("t", "distance")).alias("_m")).select(
        "run_id", F.col("_m.t").alias("trigger_step"), F.col("_m.distance").alias("failure_distance"))


def detection_increments(events: DataFrame, cells: DataFrame, p_d: float) -> DataFrame:
    """Per (run, t): gain in P (p q^before (1 - q^k)) and in L (first sighting only)."""
    q = F.lit(1.0 - p_d)
    s = step_counts(events)
    w = Window.partitionBy(*CELL).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("k").over(w), F.lit(0))
    r = s.select(*CELL, "t", "k", before.alias("before")).join(cells.select("row", "col", "p"), ["row", "col"])
    return r.groupBy("run_id", "t").agg(
        F.sum(F.col("p") * F.pow(q, F.col("before")) * (1.0 - F.pow(q, F.col("k")))).alias("dP"),
        F.sum(F.when(F.col("before") == 0, F.col("p")).otherwise(0.0)).alias("dL"))


def recovery_curve(pings: DataFrame, cells: DataFrame, grid: GridSpec, radius: float, p_d: float, every: int,
                   crossing: DataFrame, budget: float) -> DataFrame:
    """Every ``every`` steps and at the last one: fleet distance, post-event distance and share, cumulative P and L."""
    gains = detection_increments(exposure_events(pings, grid, radius), cells, p_d)
    moves = with_steps(pings).groupBy("run_id", "t").agg(F.sum("step").alias("_d"))
    last = pings.groupBy("run_id").agg(F.max("t").alias("_last"))
    # every increment is booked on the first emitted step at or after it
    slot = F.least(F.ceil(F.col("t") / every).cast("int") * every, F.col("_last"))
    g = on_keys(gains, last, ["run_id"]).groupBy("run_id", slot.alias("step")).agg(F.sum("dP").alias("dP"), F.sum("dL").alias("dL"))
    m = on_keys(moves, last, ["run_id"]).groupBy("run_id", slot.alias("step")).agg(F.sum("_d").alias("_d"))
    dense = last.select("run_id", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("_last"), F.lit(every)), F.array("_last")))).alias("step"))
    j = on_keys(on_keys(dense, g, ["run_id", "step"], "left"), m, ["run_id", "step"], "left").fillna(0.0)
    r = running_sums(j, ["run_id"], "step", {"P_detect_cumulative": F.col("dP"), "L_cumulative": F.col("dL"), "distance_absolute": F.col("_d")})
    r = on_keys(r, crossing.select("run_id", "failure_distance"), ["run_id"], "left")
    post = F.greatest(F.lit(0.0), F.col("distance_absolute") - F.col("failure_distance"))
    room = F.lit(budget) - F.col("failure_distance")
    return r.select("run_id", "step", "distance_absolute", post.alias("distance_post_fault"), F.when(room > 1e-9, post / room).alias("b_post"),
                    "P_detect_cumulative", "L_cumulative")


def pre_post_endpoints(pings: DataFrame, cells: DataFrame, grid: GridSpec, radius: float, p_d: float, crossing: DataFrame) -> DataFrame:
    """P at the event, gain after it, and the gain conditional on no earlier detection."""
    ev = on_keys(exposure_events(pings, grid, radius), crossing.select("run_id", "trigger_step"), ["run_id"], "left")
    pre = F.coalesce(F.col("t") <= F.col("trigger_step"), F.lit(True))
    c = ev.groupBy(*CELL).agg(F.count("*").alias("n"), F.count_if(pre).alias("n_pre"))
    j = c.join(cells.select("row", "col", "p"), ["row", "col"])
    g = j.groupBy("run_id").agg(F.sum(F.col("p") * _detected(p_d, F.col("n_pre"))).alias("Pdet_at_fault"),
                                F.sum(F.col("p") * _detected(p_d, F.col("n"))).alias("P_detect"), F.sum(F.col("n") - F.col("n_pre")).alias("post_exposures"))
    gain = F.col("P_detect") - F.col("Pdet_at_fault")
    return g.select("run_id", "Pdet_at_fault", "P_detect", gain.alias("PostFault_PdetGain"),
                    F.when(1.0 - F.col("Pdet_at_fault") > 1e-12, gain / (1.0 - F.col("Pdet_at_fault"))).alias("ConditionalPostFaultPdet"), "post_exposures")


def moving_target_detection(pings: DataFrame, tracks: DataFrame, radius: float, p_d: float, horizon: Column, seed: int = 0, pairs: DataFrame | None = None) -> DataFrame:
    """Hazard integration along a target track: P, RMST and the realised first hit per (run, target).

    ``pairs`` (run, target) tells which targets belong to which run: those without a contact get their row too, with P 0 and the whole
    horizon. Without it only pairs in contact have one.

    Agents and tracks meet in the same step and bucket of the plane (a target is sent to its bucket and the eight around it), so only
    close pairs are formed.
    """
    q = F.lit(1.0 - p_d)
    near = dist(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")) <= radius
    cell = lambda c: F.floor(F.col(c) / radius)
    tr = tracks.select("target_id", "t", F.col("x").alias("tx"), F.col("y").alias("ty"))
    tr = tr.withColumn("gx", F.explode(F.sequence(cell("tx") - 1, cell("tx") + 1))).withColumn("gy", F.explode(F.sequence(cell("ty") - 1, cell("ty") + 1)))
    hit = pings.withColumns({"gx": cell("x"), "gy": cell("y")}).join(tr, ["t", "gx", "gy"]).where(near)
    lucky = uniform(seed, F.col("run_id"), F.col("target_id"), F.col("agent_id"), F.col("t")) < p_d
    k = hit.groupBy("run_id", "target_id", "t").agg(F.count("*").alias("k"), F.bool_or(lucky).alias("lucky"))
    k = k.withColumn("_T", horizon).where("t <= _T")
    w = Window.partitionBy("run_id", "target_id").orderBy("t")  # at most one row per step of the horizon
    cum = F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = k.select("run_id", "target_id", "t", "k", "lucky", "_T", F.pow(q, cum).alias("_s"), (F.coalesce(F.lead("t").over(w), F.col("_T") + 1) - F.col("t")).alias("_len"))
    g = r.groupBy("run_id", "target_id").agg(F.sum("k").alias("exposures"), F.min("_s").alias("_S"), (F.min("t") + F.sum(F.col("_s") * F.col("_len"))).alias("RMST"),
                                            F.coalesce(F.min(F.when(F.col("lucky"), F.col("t"))), F.max("_T") + 1).alias("T_detect_realized"),
                                            F.bool_or("lucky").alias("detected"))
    g = g.select("run_id", "target_id", "exposures", (1.0 - F.col("_S")).alias("P_detect"), "RMST", "T_detect_realized", "detected")
    if pairs is None:
        return g
    none = {"exposures": F.lit(0), "P_detect": F.lit(0.0), "RMST": horizon + 1, "T_detect_realized": horizon + 1, "detected": F.lit(False)}
    out = pairs.select("run_id", "target_id").distinct().join(g, ["run_id", "target_id"], "left")
    return out.withColumns({c: F.coalesce(c, v.cast(g.schema[c].dataType)) for c, v in none.items()})


def realized_ttd(events: DataFrame, samples: DataFrame, p_d: float, horizon: Column, seed: int) -> DataFrame:
    """Time to the first Bernoulli success per (run, sample), T + 1 where none: ``samples`` has (sample_id, row, col).

    Samples that share a cell share its exposure rows through one equi-join on the cell.
    """
    runs = events.select("run_id").distinct()
    s = step_counts(events).join(samples, ["row", "col"])
    ok = uniform(seed, F.col("run_id"), F.col("sample_id"), F.col("t")) < _detected(p_d, F.col("k"))
    hit = s.where(ok).groupBy("run_id", "sample_id").agg(F.min("t").alias("ttd"))
    n = samples.agg(F.count("*")).scalar()
    g = hit.groupBy("run_id").agg(F.count("*").alias("hits"), F.sum("ttd").alias("_t"))
    return on_keys(runs, g, ["run_id"], "left").fillna(0).select(
        "run_id", n.alias("samples"), "hits", (F.col("hits") / n).alias("mc_P"), ((F.col("_t") + (n - F.col("hits")) * (horizon + 1)) / n).alias("mc_RMST"))


def drop_k_loss(agent_coverage: DataFrame, k: int) -> DataFrame:
    """Worst-case and average loss of a run's coverage when k agents are lost: input (run_id, agent_id, likelihood).

    ``row_number <= k`` keeps at most k rows per run and task before the shuffle (window group limit).
    """
    w = Window.partitionBy("run_id").orderBy(F.desc("likelihood"), "agent_id")
    top = agent_coverage.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).groupBy("run_id").agg(F.sum("likelihood").alias("_w"))
    tot = agent_coverage.groupBy("run_id").agg(F.sum("likelihood").alias("total"), F.count("*").alias("agents"))
    j = on_keys(tot, top, ["run_id"]).where((F.col("total") > 0) & (F.col("agents") > k))
    avg = F.col("total") / F.col("agents")
    return j.select("run_id", F.lit(k).alias("k"), F.col("total").alias("baseline_likelihood"), (F.col("total") - F.col("_w")).alias("worst_lh"),
                    (100.0 * F.col("_w") / F.col("total")).alias("worst_pct"), (F.col("total") - k * avg).alias("avg_lh"), (100.0 * k * avg / F.col("total")).alias("avg_pct"))


def termination(df: DataFrame, budget: float) -> DataFrame:
    """budget_exhausted, path_exhausted or completed, plus budget utilisation; needs distance, progress, path_length."""
    tol = 1e-9 * max(1.0, budget)
    reason = F.when(F.col("distance") >= budget - tol, "budget_exhausted").when(F.col("progress") >= F.col("path_length") - 1e-9, "path_exhausted").otherwise("completed")
    return df.withColumns({"termination_reason": reason, "budget_utilization": F.col("distance") / budget})


def agent_time_series(pings: DataFrame, cells: DataFrame, grid: GridSpec, radius: float, gamma: float) -> DataFrame:
    """One row per (run, agent, step): position with the running coverage of that path."""
    c = cumulative_coverage(pings, cells, grid, radius, gamma)
    return on_keys(pings.select(*PATH, "t", "x", "y"), c, PATH + ["t"])
