"""Ping streams: ingest, windowed aggregates and stateful operators, each with a batch twin in ``operators``.

Everything runs in append mode with a watermark, so results go to file sinks and a restart resumes from the checkpoint. Stateful
processors take their input from ``stream_pings``: its deduplication also asks for the batch without data that fires the last timers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from coverlens.operators.grid import GridSpec, footprint
from coverlens.sources.io import scratch_path

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_pings(pings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Watermark on ``ts``; an event delivered again (same ``event_id``) while it can still be compared goes. Every other ping stays,
    also several of an agent within a step."""
    return pings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_exposure(pings: DataFrame, grid: GridSpec, radius: float, window: str | None = "1 day") -> DataFrame:
    """Exposure counts per cell: closed-window increments (append), or running totals when no window is given (update)."""
    f = footprint(pings, grid, radius)
    keys = ["run_id", "row", "col"]
    if window is None:
        return f.groupBy(*keys).agg(F.count("*").alias("n"))
    g = f.groupBy(F.window("ts", window), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def stream_coverage(pings: DataFrame, cells: DataFrame, grid: GridSpec, radius: float, window: str, slide: str | None = None) -> DataFrame:
    """Prior mass and cells seen per run and tumbling or sliding window."""
    f = footprint(pings, grid, radius).select("run_id", "row", "col", F.window("ts", window, slide or window).alias("w"), "ts")
    once = f.groupBy("w", "run_id", "row", "col").agg(F.max("ts").alias("ts"))
    j = once.join(cells.select("row", "col", "p"), ["row", "col"])
    g = j.groupBy("w", "run_id").agg(F.sum("p").alias("L"), F.count("*").alias("cells"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "run_id", "L", "cells")


def stream_sessions(pings: DataFrame, gap: str) -> DataFrame:
    """Activity sessions per agent: a silence longer than the gap closes one."""
    g = pings.groupBy(F.session_window("ts", gap), "run_id", "agent_id").agg(F.count("*").alias("pings"))
    return g.select("run_id", "agent_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "pings")


BLOCK = 16
PARTS = 64
#: Time constants after which a weight 1 - (1 - w) exp(-x) is 1 in double precision.
RECOVERED = 38


def _due(step: str) -> Column:
    """End of the step that holds ``ts``, in milliseconds: with the watermark there, the step is complete."""
    ms = F.lit(int(pd.Timedelta(step).total_seconds() * 1000))
    return ((F.floor(F.unix_millis("ts") / ms) + 1) * ms).alias("due")


class EvidenceProcessor(StatefulProcessor):
    """Per (run, block of cells): evidence weight and last observed step of each cell, as arrays so that one state access serves a block.

    Looks wait in the buffer until the watermark passes the end of their step, so that a late one still takes its place; then all complete
    steps are applied in order, at the first timer that fires. A block keeps one timer for its next step, however many steps wait. With
    recovery, a block is forgotten when it has been silent until all its weights are 1 again; without, never.
    """

    def __init__(self, p_d: float, tau: float, block: int, step_ms: int):
        self.p_d, self.tau, self.block, self.step_ms = p_d, tau, block, step_ms
        self.recovering = 0 < tau < float("inf")
        self.forget_ms = int(np.ceil(RECOVERED * tau) + 1) * step_ms if self.recovering else 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("evidence", "ell array<double>, t array<int>, seen_ms long")
        self.held = handle.getListState("held", "due long, t int, cells array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        looks: dict[tuple, set] = {}
        for p in rows:
            p = p.assign(cell=(p["row"] % self.block) * self.block + p["col"] % self.block)[["due", "t", "cell"]].drop_duplicates()
            for (due, t), g in p.groupby(["due", "t"]):
                looks.setdefault((int(due), int(t)), set()).update(g["cell"].tolist())
        if looks:
            self.held.appendList([(due, t, sorted(int(c) for c in cells)) for (due, t), cells in looks.items()])
            self.handle.registerTimer(min(due for due, _ in looks))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [(int(r[0]), int(r[1]), list(r[2])) for r in self.held.get()] if self.held.exists() else []
        ready: dict[tuple, set] = {}
        for due, t, cells in held:
            if due <= now:
                ready.setdefault((due, t), set()).update(cells)
        old = self.state.get()
        if not ready:
            if old is not None and not held and self.recovering and int(old[2]) + self.forget_ms <= now:
                self.state.clear()
            return
        waiting = [r for r in held if r[0] > now]
        if waiting:
            self.held.put(waiting)
            self.handle.registerTimer(min(r[0] for r in waiting))
        else:
            self.held.clear()
        size = self.block * self.block
        ell, last = (np.ones(size), np.full(size, -1, dtype=np.int64)) if old is None else (np.array(v) for v in old[:2])
        out = []
        for (due, step), cells in sorted(ready.items()):
            c = np.array(sorted(cells))
            if self.recovering:
                known = c[last[c] >= 0]
                ell[known] = 1.0 - (1.0 - ell[known]) * np.exp(-(step - last[known]) / self.tau)
            ell[c] *= 1.0 - self.p_d
            last[c] = step
            out.append((c, ell[c], np.full(len(c), step)))
        seen = max(due for due, _ in ready)
        self.state.update((ell.tolist(), last.tolist(), seen))
        if self.recovering:
            self.handle.registerTimer(seen + self.forget_ms)
        c, weight, step = (np.concatenate(x) for x in zip(*out))
        yield pd.DataFrame({"run_id": [key[0]] * len(c), "row": key[1] * self.block + c // self.block, "col": key[2] * self.block + c % self.block, "ell": weight, "last_t": step})

    def close(self) -> None:
        pass


def stream_evidence(pings: DataFrame, grid: GridSpec, radius: float, p_d: float, tau: float, step: str = "1 hour", block: int = BLOCK) -> DataFrame:
    """Evidence weights of the cells of each completed step; ``step`` is the length of a step ``t`` in event time."""
    f = footprint(pings, grid, radius).select("run_id", "row", "col", "t", "ts", _due(step), F.floor(F.col("row") / block).cast("int").alias("br"), F.floor(F.col("col") / block).cast("int").alias("bc"))
    step_ms = int(pd.Timedelta(step).total_seconds() * 1000)
    return f.groupBy("run_id", "br", "bc").transformWithStateInPandas(
        EvidenceProcessor(p_d, tau, block, step_ms), "run_id string, row int, col int, ell double, last_t int", "Append", "EventTime")


MOVES = "run_id string, agent_id long, t int, event_id long, step double, dt int"
STEP_SUMS = "run_id string, due long, t int, step double"


class MoveProcessor(StatefulProcessor):
    """Per (run, part of the agents): distance of each ping from the agent's previous one, in the order of event time and event id.

    Pings wait until the watermark passes the end of their step; then those of all complete steps go at once, at the first timer that fires.
    One timer stands for the next step, however many steps wait. With ``keep_ms`` an agent silent for that long is forgotten.
    """

    def __init__(self, sums: bool, keep_ms: int | None):
        self.sums, self.keep_ms = sums, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "agent_id long", "x double, y double, t int, due long")
        self.held = handle.getListState("held", "due long, us long, event_id long, agent_id long, t int, x double, y double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for p in rows:
            columns = [p[c].tolist() for c in ("due", "us", "event_id", "agent_id", "t", "x", "y")]
            if columns[0]:
                self.held.appendList(list(zip(*columns)))
                self.handle.registerTimer(int(min(columns[0])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ready = [r for r in held if r[0] <= now]
        if not ready:
            self._forget(now)
            return
        if len(ready) < len(held):
            waiting = [r for r in held if r[0] > now]
            self.held.put(waiting)
            self.handle.registerTimer(int(min(r[0] for r in waiting)))
        else:
            self.held.clear()
        p = pd.DataFrame(ready, columns=["due", "us", "event_id", "agent_id", "t", "x", "y"]).sort_values(["agent_id", "us", "event_id"], kind="stable")
        before = p.groupby("agent_id")[["x", "y", "t"]].shift()
        first = ~p["agent_id"].duplicated()
        places, known = [], []
        for i, agent in zip(np.flatnonzero(first), p["agent_id"][first]):
            if self.last.containsKey((int(agent),)):
                places.append(i)
                known.append(self.last.getValue((int(agent),))[:3])
        if places:
            before.iloc[places] = known
        ends = p[~p["agent_id"].duplicated(keep="last")]
        for r in ends.itertuples():
            self.last.updateValue((int(r.agent_id),), (float(r.x), float(r.y), int(r.t), int(r.due)))
        if self.keep_ms is not None:
            self.handle.registerTimer(int(ends["due"].max()) + self.keep_ms)
        self._forget(now)
        step = np.sqrt((p["x"] - before["x"]) ** 2 + (p["y"] - before["y"]) ** 2).fillna(0.0)
        if self.sums:
            yield p[["due", "t"]].assign(step=step).groupby(["due", "t"], as_index=False)["step"].sum().assign(run_id=key[0])[["run_id", "due", "t", "step"]]
        else:
            yield pd.DataFrame({"run_id": key[0], "agent_id": p["agent_id"], "t": p["t"], "event_id": p["event_id"], "step": step, "dt": (p["t"] - before["t"]).astype("Int32")})

    def _forget(self, now: int) -> None:
        """After the steps up to ``now`` are applied: agents that have been silent for so long."""
        if self.keep_ms is not None:
            for agent, old in list(self.last.iterator()):
                if old[3] + self.keep_ms <= now:
                    self.last.removeKey(agent)

    def close(self) -> None:
        pass


def _moves(pings: DataFrame, step: str, schema: str, keep_ms: int | None = None) -> DataFrame:
    cols = [F.col("agent_id").cast("long").alias("agent_id"), "event_id", "t", "x", "y", "ts", F.unix_micros("ts").alias("us"), _due(step)]
    p = pings.select("run_id", F.pmod(F.hash("agent_id"), F.lit(PARTS)).alias("part"), *cols)
    return p.groupBy("run_id", "part").transformWithStateInPandas(MoveProcessor(schema == STEP_SUMS, keep_ms), schema, "Append", "EventTime")


def stream_steps(pings: DataFrame, step: str = "1 hour") -> DataFrame:
    """(run, agent, t, event_id, step, dt): movement of each agent since its previous ping, null dt for its first."""
    return _moves(pings, step, MOVES)


def stream_step_bound(pings: DataFrame, bound: float, step: str = "1 hour", reach: float | None = None) -> DataFrame:
    """Moves longer than the bound times the elapsed steps, at least one. ``reach`` is the longest distance that positions allow: an agent
    silent for so many steps that no move can break the bound is forgotten."""
    keep = None if reach is None else int(np.ceil(reach / bound) + 1) * int(pd.Timedelta(step).total_seconds() * 1000)
    return _moves(pings, step, MOVES, keep).where(F.col("step") > F.lit(bound) * F.greatest("dt", F.lit(1)) * F.when(F.col("dt").isNotNull(), 1))


class CrossingProcessor(StatefulProcessor):
    """Per run: fleet distance so far; one alert on the first step at or over the threshold. Sums of a step arrive in one batch."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fleet", "distance double, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps: dict[tuple, float] = {}
        for p in rows:
            for due, t, step in zip(p["due"], p["t"], p["step"]):
                steps[due, t] = steps.get((due, t), 0.0) + step
        old = self.state.get()
        distance, fired = old if old is not None else (0.0, False)
        for due, t in sorted(steps):
            distance += steps[due, t]
            if distance >= self.threshold and not fired:
                yield pd.DataFrame({"run_id": [key[0]], "trigger_step": [int(t)], "failure_distance": [float(distance)]})
                fired = True
        self.state.update((float(distance), bool(fired)))

    def close(self) -> None:
        pass


def stream_crossing(pings: DataFrame, threshold: float, step: str = "1 hour") -> DataFrame:
    """Budget-crossing alerts. Moves are summed per run, step and part of the agents first: a run sees at most PARTS rows per step."""
    per = _moves(pings, step, STEP_SUMS)
    return per.groupBy("run_id").transformWithStateInPandas(CrossingProcessor(threshold), "run_id string, trigger_step int, failure_distance double", "Append", "None")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the progress that the query still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


@contextmanager
def _rocksdb(spark: SparkSession):
    """Stateful processors keep their state in RocksDB; the session setting is put back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _drain(stream: DataFrame, name: str) -> tuple[str, StreamingQuery]:
    path = scratch_path(stream.sparkSession, name)
    with _rocksdb(stream.sparkSession):
        q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return path, q


def drain(stream: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write the available input to Parquet below the shared checkpoint folder; the table, and how many rows came too late for it."""
    path, q = _drain(stream, name)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data"), late_rows(q)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    return drain(stream, name)[0]


def exposure_totals(pings: DataFrame, grid: GridSpec, radius: float, name: str, window: str = "1 day") -> DataFrame:
    """Exposure counts per cell over all pings so far: increments of closed windows from the sink, counts of windows that are still open from
    the checkpoint's state."""
    spark, stream = pings.sparkSession, stream_exposure(pings, grid, radius, window)
    path, _ = _drain(stream, name)
    keys = ["run_id", "row", "col"]
    closed = spark.read.schema(stream.schema).parquet(f"{path}/data").select(*keys, "n")
    counts = spark.read.format("state-metadata").load(f"{path}/state").where("operatorName = 'stateStoreSave'").first()
    if counts is None:  # no input, no state
        return closed
    held = spark.read.format("statestore").option("operatorId", counts.operatorId).load(f"{path}/state")
    held = held.select("key.*", F.col("value.count").alias("n")).select(*keys, "n")
    return closed.unionByName(held).groupBy(*keys).agg(F.sum("n").alias("n"))
