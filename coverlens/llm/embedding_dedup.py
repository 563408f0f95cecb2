"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors of a label form one class. All vectors are turned into the axes of their second-moment matrix, largest first. Within a
label, classes are cut along the first axis into blocks of bounded size, and only blocks close enough on that axis to hold a pair above
the threshold meet in a tile. A tile adds up the products of leading axes first, bounds the rest by the product of the suffix norms and
drops every pair that cannot reach the threshold; survivors are decided by the cosine of the given vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlens.llm.common import checkpointed, linked_rows

THRESHOLD = 0.93
BLOCK = 2048
BINS = 512
CHUNK = 512
SLACK = 1e-9
#: Leading axes after which pairs are dropped.
CUTS = (8, 16, 32)


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, set_key, vec) with vec the doubles of a usable vector; all but id and label null for one that links with nothing."""
    schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, label {vectors.schema[label_col].dataType.simpleString()}, dim int, set_key binary, vec binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, data = [], [], []
            for v, label in zip(batch.column(1), batch.column(2).to_pylist()):
                x = None
                if label is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                    norm = x @ x
                    x = x + 0.0 if 0 < norm < np.inf else None  # + 0.0: one zero
                dims.append(None if x is None else len(x))
                data.append(None if x is None else x.tobytes())
                keys.append(None if x is None else xxhash.xxh3_128_digest(f"{label}\0".encode() + data[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], [id_col, "label", "dim", "set_key", "vec"])

    return vectors.select(id_col, vec_col, label_col).mapInArrow(run, schema)


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the orthonormal axes of all unit vectors' second moments, as columns, largest first.

    Sums of dim x dim numbers per task are added up by Spark; only their totals reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim in {d for d in batch.column(0).to_pylist()}:
                x = units(np.stack([np.frombuffer(v, np.float64) for d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d == dim]))
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["dim", "i", "row"])

    cells = classes.select("dim", "vec").mapInArrow(run, "dim int, i int, row array<double>").select("dim", "i", F.posexplode("row").alias("j", "v"))
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["i"], r["j"]] = r["v"]
    return {dim: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy() for dim, m in out.items()}


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def close_pairs(x: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of pairs of rows of x and y with at least the threshold, chunk by chunk; only i < j if both are the same rows."""
    u, v = units(x), units(y)
    a, b = u @ turn, v @ turn
    dim = a.shape[1]
    cuts = [c for c in CUTS if c < dim]
    bounds = [0, *cuts, dim]
    rest_a = [np.sqrt((a[:, c:] ** 2).sum(1)) for c in bounds[1:]]
    rest_b = [np.sqrt((b[:, c:] ** 2).sum(1)) for c in bounds[1:]]
    low = threshold - SLACK
    for start in range(0, len(a), CHUNK):
        part = slice(start, start + CHUNK)
        first = bounds[1]
        total = a[part, :first] @ b[:, :first].T
        i, j = np.nonzero(total + rest_a[0][part, None] * rest_b[0] >= low)
        total = total[i, j]
        i += start
        if same:
            upper = i < j
            i, j, total = i[upper], j[upper], total[upper]
        for k, (c, d) in enumerate(zip(bounds[1:], bounds[2:]), 1):
            total = total + np.einsum("nd,nd->n", a[i, c:d], b[j, c:d])
            alive = total + rest_a[k][i] * rest_b[k][j] >= low
            i, j, total = i[alive], j[alive], total[alive]
        exact = np.einsum("nd,nd->n", x[i], y[j]) / (np.sqrt((x[i] ** 2).sum(1)) * np.sqrt((y[j] ** 2).sum(1))) >= threshold
        yield i[exact], j[exact]


def compare(threshold: float, turns: dict[int, np.ndarray]):
    """Function of one tile: (set_key, links, root) of every class linked in it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, one, two = key[1].as_py(), key[2].as_py(), key[3].as_py()
        rows = rows.sort_by("set_key")
        name, size, block = rows["set_key"].to_pylist(), np.array(rows["size"]), np.array(rows["block"])
        data = np.stack([np.frombuffer(v, np.float64) for v in rows["vec"].to_pylist()])
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        links, root, linked = np.zeros(len(name), np.int64), np.arange(len(name)), np.zeros(len(name), bool)
        for i, j in close_pairs(data[left], data[right], turns[dim], threshold, one == two):
            i, j = left[i], right[j]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            linked[i] = linked[j] = True
            while len(i):  # the smaller root of each pair, until none differs
                np.minimum.at(root, root[i], root[j])
                np.minimum.at(root, root[j], root[i])
                while (root[root] != root).any():
                    root = root[root]
                alive = root[i] != root[j]
                i, j = i[alive], j[alive]
        at = np.flatnonzero(linked)
        return pa.table([pa.array([name[k] for k in at], pa.binary()), pa.array(links[at]), pa.array([name[root[k]] for k in at], pa.binary())], ["set_key", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link when their labels and lengths are equal and their cosine is at least the threshold. A null label, a null or zero vector
    or one with a null or non-finite component links with nothing and is its own component. Repeated rows are copies of each other;
    other columns are not read. An empty table gives an empty result."""
    rows = checkpointed(prepared(vectors, id_col, vec_col, label_col))
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(id_col).alias("rep"), F.count("*").alias("size"), F.min("label").alias("label"), F.min("dim").alias("dim"), F.min("vec").alias("vec"))
    classes = checkpointed(classes)
    turns = axes(classes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    schema = f"set_key binary, size long, label {vectors.schema[label_col].dataType.simpleString()}, dim int, bin int, vec binary"

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(v, np.float64) for v in batch.column(4).to_pylist()]
            first = [float(v @ turns[len(v)][:, 0] / np.sqrt(v @ v)) for v in x]
            bins = pa.array([int((min(1.0, max(-1.0, f)) + 1) / 2 * (BINS - 1)) for f in first], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], bins, batch.column(4)], ["set_key", "size", "label", "dim", "bin", "vec"])

    placed = classes.select("set_key", "size", "label", "dim", "vec").mapInArrow(binned, schema)
    sizes = placed.groupBy("label", "dim", "bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label", "dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bins = sizes.select("label", "dim", "bin", F.floor(before / BLOCK).cast("int").alias("run"), "n")
    runs = bins.groupBy("label", "dim", "run").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    blocks = runs.select("label", "dim", "run", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("block", F.struct("run", "part"))
    # bins are 2 / (BINS - 1) wide: the gap between two blocks on the first axis is at least this
    other = blocks.select("label", "dim", F.col("lo").alias("lo2"), F.col("block").alias("two"))
    gap = (F.col("lo2") - F.col("hi") - 1) * (2.0 / (BINS - 1))
    tiles = blocks.join(other, ["label", "dim"]).where((F.col("block") <= F.col("two")) & (gap <= reach)).select("label", "dim", F.col("block").alias("one"), "two")
    sides = tiles.withColumn("block", F.col("one")).union(tiles.where("one <> two").withColumn("block", F.col("two")))
    spread = bins.join(runs.select("label", "dim", "run", "parts"), ["label", "dim", "run"]).select("label", "dim", "bin", "run", "parts")
    part = F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int")
    members = placed.join(spread, ["label", "dim", "bin"]).select("label", "dim", F.struct("run", part.alias("part")).alias("block"), "set_key", "size", "vec")
    met = members.join(sides, ["label", "dim", "block"])
    found = checkpointed(met.groupBy("label", "dim", "one", "two").applyInArrow(compare(threshold, turns), "set_key binary, links long, root binary"))
    out = linked_rows(rows, classes, found, id_col)
    return out.select(id_col, "n_links", F.col("class_id").alias("component_id"), "kept")
