"""Mass-conserving belief with recovery, as a recurrence of a few numbers per run and step.

All cells of a run meet only in the two normalisers of a step. Given those, a cell folds over its own observations alone: it is its prior
times the product of all normalisers until it is first seen, and relaxes from its last observed value to its prior afterwards. So cells
stay in (run, block of cells) rows, and a sweep sends one row of sums per block and observed step to the run, where they give the
normalisers anew. They depend on earlier steps only: every sweep settles at least one more step, and in practice some dozen sweeps settle
all of them, since an error in a step enters later ones with the share of mass that is looked at. A run's own row holds three numbers per
step of the horizon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.session import cut_lineage

SIDE = 32
SETTLED = 1e-14
BLOCKS = "run_id string, cells binary, prior binary, t binary, at binary"
SUMS = ("seen_mass", "recovered", "left", "newly", "looked")
SCALES = "run_id string, s1 binary, s2 binary, u binary, change double"


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("t")
    code = np.asarray(rows["row"], np.int64) << 32 | np.asarray(rows["col"], np.int64)
    cells, first, at = np.unique(code, return_index=True, return_inverse=True)
    data = (cells, np.asarray(rows["p"], np.float64)[first], np.asarray(rows["t"], np.int64), at.astype(np.int64))
    return pa.table([pa.array([key[0].as_py()]), *[pa.array([v.tobytes()], pa.binary()) for v in data]], ["run_id", "cells", "prior", "t", "at"])


class _Block:
    """The cells of a block folded over their observations, given the normalisers of every step."""

    def __init__(self, row: dict, q: float, tau: float, time_zero: bool):
        self.run, self.q, self.tau, self.time_zero = row["run_id"], q, tau, time_zero
        self.cells, self.t, self.at = (np.frombuffer(row[c], np.int64) for c in ("cells", "t", "at"))
        self.p = np.frombuffer(row["prior"], np.float64)
        self.s1, self.s2, self.u = (np.frombuffer(row[c], np.float64) for c in ("s1", "s2", "u"))
        self.free, self.base, self.last = self.p.copy(), np.zeros(len(self.p)), np.full(len(self.p), -1)

    def relaxed(self, c, t: int) -> np.ndarray:
        return self.p[c] - (self.p[c] - self.base[c]) * np.exp(-(t - self.last[c]) / self.tau)

    def steps(self) -> Iterator[tuple]:
        """(run, step, mass looked at before it, gap to the prior of cells seen again, untouched mass that leaves, prior newly seen, prior looked at)."""
        cuts = np.flatnonzero(np.diff(self.t)) + 1
        for t, c in zip(self.t[np.concatenate([[0], cuts])].tolist(), np.split(self.at, cuts)):
            fresh = self.last[c] < 0
            u, s2 = (self.u[t - 1], self.s2[t - 1]) if t else (1.0, 1.0)
            v = np.where(fresh, self.free[c] * u, self.relaxed(c, t - 1) * s2)
            mass = v.sum()
            if t == 0 and not self.time_zero:  # seen at the start counts as never seen, with less mass
                yield self.run, t, mass, 0.0, (1 - self.q) * self.p[c].sum(), 0.0, 0.0
                self.free[c] *= self.q
                continue
            old, new = c[~fresh], c[fresh]
            yield self.run, t, mass, (self.p[old] - self.relaxed(old, t)).sum(), self.free[new].sum(), self.p[new].sum(), self.p[c].sum()
            self.base[c], self.last[c] = self.q * self.s1[t] * v, t

    def at_end(self) -> np.ndarray:
        end = len(self.u) - 1
        everything = np.arange(len(self.p))
        return np.where(self.last < 0, self.free * self.u[end], self.relaxed(everything, end) * self.s2[end])


def _normalisers(mass: float, p_d: float, tau: float, end: int, time_zero: bool):
    """Function of the sums of a run: both normalisers of each step and their product so far."""

    def run(key: tuple, sums: pa.Table, before: pa.Table) -> pa.Table:
        q, fade = 1.0 - p_d, np.exp(-1.0 / tau)
        x = np.zeros((end + 1, len(SUMS)))
        x[np.asarray(sums["t"])] = np.stack([np.asarray(sums[c], np.float64) for c in SUMS], 1)
        s1, s2, u = np.ones(end + 1), np.ones(end + 1), np.ones(end + 1)
        product, gap, fresh_gap, seen, free = 1.0, 0.0, 0.0, 0.0, mass
        for t, (looked_mass, recovered, left, newly, looked) in enumerate(x.tolist()):
            rest = mass - p_d * looked_mass
            s1[t] = mass / rest if rest > 0 else 1.0
            gap = fade * (gap + fresh_gap) - recovered
            seen, free = seen + newly, free - left
            now = 0.0 if t == 0 and not time_zero else q * s1[t] * looked_mass
            total = free * product * s1[t] + now + seen - looked - gap
            s2[t] = mass / total if total > 0 else 1.0
            product *= s1[t] * s2[t]
            u[t], fresh_gap = product, looked - now
        old = np.stack([np.frombuffer(before[c][0].as_py(), np.float64) for c in ("s1", "s2", "u")])
        new = np.stack([s1, s2, u])
        change = float(np.abs(new / old - 1).max())
        return pa.table([pa.array([key[0].as_py()]), *[pa.array([v.tobytes()], pa.binary()) for v in new], pa.array([change])], ["run_id", "s1", "s2", "u", "change"])

    return run


def settled_belief(obs: DataFrame, cells: DataFrame, p_d: float, tau: float, end: int, time_zero: bool = True) -> DataFrame:
    """(run_id, row, col, posterior) after step `end`: touched cells, and the mass of all others as row = col = -1.

    Every step looks at its cells (they keep 1 - p_d and all mass is brought back to its total), then every cell seen before it relaxes
    from its value right after that look towards its prior, and the total is restored again. Observations after `end` are not used."""
    rows = obs.select("run_id", "row", "col", "t").where(F.col("t") <= end).distinct().join(cells.select("row", "col", "p"), ["row", "col"])
    keyed = rows.select("run_id", F.floor(F.col("row") / SIDE).alias("br"), F.floor(F.col("col") / SIDE).alias("bc"), "row", "col", "t", "p")
    blocks = cut_lineage(keyed.groupBy("run_id", "br", "bc").applyInArrow(_pack, BLOCKS))
    mass = cells.agg(F.sum("p")).first()[0] or 0.0
    ones = F.lit(np.ones(end + 1).tobytes())
    scales = blocks.select("run_id").distinct().select("run_id", ones.alias("s1"), ones.alias("s2"), ones.alias("u"), F.lit(1.0).alias("change"))
    scales = cut_lineage(scales)
    recur = _normalisers(mass, p_d, tau, end, time_zero)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = list(_Block(row, 1.0 - p_d, tau, time_zero).steps())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int32(), *[pa.float64()] * len(SUMS)))], ["run_id", "t", *SUMS])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, 1.0 - p_d, tau, time_zero)
                for _ in b.steps():
                    pass
                out = ((b.cells >> 32).astype(np.int32), (b.cells & 0xFFFFFFFF).astype(np.int32), b.at_end(), b.p, np.full(len(b.p), b.u[-1]))
                yield pa.RecordBatch.from_arrays([pa.array([b.run] * len(b.p), pa.string()), *map(pa.array, out)], ["run_id", "row", "col", "posterior", "p", "kept"])

    schema = "run_id string, t int, " + ", ".join(f"{c} double" for c in SUMS)
    while (scales.agg(F.max("change")).first()[0] or 0.0) > SETTLED:
        found = blocks.join(scales.drop("change"), "run_id").mapInArrow(sums, schema).groupBy("run_id", "t").agg(*[F.sum(c).alias(c) for c in SUMS])
        scales = cut_lineage(found.groupBy("run_id").cogroup(scales.groupBy("run_id")).applyInArrow(recur, SCALES))
    out = cut_lineage(blocks.join(scales.drop("change"), "run_id").mapInArrow(values, "run_id string, row int, col int, posterior double, p double, kept double"))
    rest = (F.lit(mass) - F.sum("p")) * F.max("kept")
    unseen = out.groupBy("run_id").agg(F.lit(-1).alias("row"), F.lit(-1).alias("col"), rest.alias("posterior"))
    return out.select("run_id", "row", "col", "posterior").unionByName(unseen)
