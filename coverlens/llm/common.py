"""Shared helpers of the operators: table reading, columns of Arrow batches, slices balanced by bytes, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.session import checkpoint_dir, cut_lineage

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return pc.fill_null(column, "").to_pylist()


def byte_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts add up to about `limit` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


_state: dict = {}


def give_back() -> None:
    """Returns freed memory of this worker to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_state(key=None, build=None):
    """The one heavy object that a Python worker keeps over its tasks; asking for another key, or for none, frees it."""
    if key not in _state:
        if _state:
            _state.clear()
            give_back()
        if build is not None:
            _state[key] = build()
    return _state.get(key)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of a task's batches, which gives freed memory back at its end: a worker that waits holds its state alone."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows read back from the shared checkpoint folder: computed once, safe against lost executors."""
    return cut_lineage(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows read back from a Parquet table below the shared checkpoint folder: as safe as a checkpoint, and compressed."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that the undirected edges connect each node with.

    Every round points each node to its smallest neighbour or itself, follows the pointers to their ends by doubling, and rewrites the
    edges between the ends, of which at most half as many are left. A chain costs the logarithm of its length. A hub sends one row per
    neighbour and its minimum is aggregated before the shuffle. All tables stay distributed."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = checkpointed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    names = None
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("v", "u"))
        step = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("to")))
        moving = True
        while moving:
            onward = step.where("node <> to").select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = checkpointed(step.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            moving = not step.where("moved").isEmpty()
        if names is None:
            names = step.select("node", F.col("to").alias("root"))
        else:
            names = names.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        names = checkpointed(names)
        pairs = pairs.join(step.select(F.col("node").alias("u"), F.col("to").alias("x")), "u").join(step.select(F.col("node").alias("v"), F.col("to").alias("y")), "v")
        pairs = checkpointed(pairs.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    if names is None:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return names


def linked_rows(rows: DataFrame, classes: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """(id, set_key, class_id, n_links, kept) of rows (id, set_key), whose equal keys form classes (set_key, rep, size).

    `found` has (set_key, links, root) rows of linked classes: link counts to add up, and another class that links connect them with.
    class_id is the smallest rep that links reach; a null key links with nothing and is its own class. Equal keys may hold a third of
    all rows, so class facts are computed per key and joined to the rows last."""
    roots = components(found, "set_key", "root").select(F.col("node").alias("set_key"), "root")
    counts = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    known = classes.select("set_key", "rep", "size").join(roots, "set_key", "left").join(counts, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    ids = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = known.join(ids, "root").select("set_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    own = F.when(F.col("set_key").isNull(), F.col(id_col)).otherwise(F.col("class_id"))
    out = rows.select(id_col, "set_key").join(known, "set_key", "left").select(id_col, "set_key", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col(id_col).eqNullSafe(F.col("class_id")), F.lit(False)))
