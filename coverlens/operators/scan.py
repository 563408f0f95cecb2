"""Ordered scans that never put a whole key into one task.

A window over a key sorts all its rows in one task. These helpers cut each key into chunks of its order, scan inside the
chunks, and carry one summary row per chunk across the key, so a key holding a third of the table still spreads out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
SPLITS = 64


def on_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on (non-null) keys; plain equality keeps the partitioning usable by the next step.

    Without keys ``other`` is the single row of a global aggregate and comes in as a scalar subquery, not as a cross join.
    """
    if keys:
        return df.join(other, keys, how)
    one = other.select(F.struct("*")).scalar()
    return df.withColumn("__one", one).select(*df.columns, *[F.col("__one")[c].alias(c) for c in other.columns])


def with_totals(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Attach per-key aggregates by aggregate-and-join (partial aggregation first, no whole-key window)."""
    aggs = [c.alias(n) for n, c in totals.items()]
    return on_keys(df, df.groupBy(*keys).agg(*aggs), keys)


def with_few_totals(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """The same where few keys hold very many rows each, as grids hold cells: each key's totals are sent SPLITS times and its rows share them
    out by a hash, so that a key's rows do not meet in one task. The columns of ``df`` must be hashable."""
    few = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]).withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    dealt = df.withColumn("_split", F.pmod(F.xxhash64(*df.columns), F.lit(SPLITS)).cast("int"))
    return on_keys(dealt, few, [*keys, "_split"]).drop("_split")


def chunk(df: DataFrame, order: str, width: int = CHUNK) -> DataFrame:
    """Add the chunk number. Scans keep a ``_chunk`` they are given, so a chain of scans shares one shuffle."""
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)))


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], width: int = CHUNK) -> DataFrame:
    """Inclusive running sums by an integer order column that is unique within the key."""
    names = list(sums)
    c = df.select("*", *[e.alias(f"_v{i}") for i, e in enumerate(sums.values())])
    c = c if "_chunk" in df.columns else chunk(c, order, width)
    parts = c.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))])
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_s{i}").over(w), F.lit(0)).alias(f"_c{i}") for i in range(len(names))])
    lw = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = on_keys(c, carry, keys + ["_chunk"])
    return joined.select(*df.columns, *[(F.col(f"_c{i}") + F.sum(f"_v{i}").over(lw)).alias(n) for i, n in enumerate(names)])


def _neighbour(df: DataFrame, keys: list[str], order: str, cols: list[str], prefix: str, back: bool, width: int) -> DataFrame:
    c = df if "_chunk" in df.columns else chunk(df, order, width)
    edge, shift = (F.max_by, F.lag) if back else (F.min_by, F.lead)
    parts = c.groupBy(*keys, "_chunk").agg(*[edge(n, order).alias(n) for n in cols])
    w = Window.partitionBy(*keys).orderBy("_chunk")
    carry = parts.select(*keys, "_chunk", *[shift(n).over(w).alias(f"_carry_{n}") for n in cols])
    lw = Window.partitionBy(*keys, "_chunk").orderBy(order)
    inside = shift(F.lit(True)).over(lw)  # null on the edge row of a chunk, whose neighbour comes from the carry
    joined = on_keys(c, carry, keys + ["_chunk"])
    return joined.select(*df.columns, *[F.when(inside, shift(n).over(lw)).otherwise(F.col(f"_carry_{n}")).alias(f"{prefix}{n}") for n in cols])


def with_previous(df: DataFrame, keys: list[str], order: str, cols: list[str], width: int = CHUNK) -> DataFrame:
    """lag(1) of ``cols`` as ``prev_*``."""
    return _neighbour(df, keys, order, cols, "prev_", True, width)


def with_next(df: DataFrame, keys: list[str], order: str, cols: list[str], width: int = CHUNK) -> DataFrame:
    """lead(1) of ``cols`` as ``next_*``."""
    return _neighbour(df, keys, order, cols, "next_", False, width)


def _place(df: DataFrame, bounds: str, value: str, out: str) -> DataFrame:
    """Number of entries of a sorted array (at most SPLITS - 1 long) that are <= value, by unrolled binary search."""
    keep = df.columns
    df = df.withColumn(out, F.lit(0))
    step = SPLITS // 2
    while step:
        up = F.coalesce(F.get(bounds, F.col(out) + (step - 1)) <= F.col(value), F.lit(False))
        df = df.select(*keep, (F.col(out) + F.when(up, step).otherwise(0)).alias(out))
        step //= 2
    return df


def sums_below(df: DataFrame, keys: list[str], value: str, sums: list[str], totals: bool = False) -> DataFrame:
    """Exclusive running sums ``<s>_below`` in ``value`` order, with ``totals`` also the whole key's ``<s>_all``; (keys, value) must be
    unique and value numeric.

    All keys share the cut points, quantiles of the rows that a hash picks: they come in as one scalar, and no key has more than about one
    in SPLITS of all rows in a part. Rows meet the sums of the parts before theirs by key and part, so a key that holds most rows never
    meets in one task. The same rows give the same cut points whenever they are computed, and the result is exact whatever points are chosen.
    """
    probs = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
    picked = df.where(F.pmod(F.xxhash64(*keys, value), F.lit(CHUNK)) == 0)
    placed = _place(df.withColumn("__b", picked.agg(F.array_sort(F.percentile(value, probs))).scalar()), "__b", value, "__p").drop("__b")
    segs = placed.groupBy(*keys, "__p").agg(*[F.sum(s).alias(s) for s in sums])
    below = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # at most SPLITS parts of a key
    whole = [F.sum(s).over(Window.partitionBy(*keys)).alias(f"{s}_all") for s in sums] if totals else []
    carry = segs.select(*keys, "__p", *[F.coalesce(F.sum(s).over(below), F.lit(0)).alias(f"__c_{s}") for s in sums], *whole)
    w = Window.partitionBy(*keys, "__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    hit = on_keys(placed, carry, [*keys, "__p"])
    return hit.select(*df.columns, *[(F.col(f"__c_{s}") + F.coalesce(F.sum(s).over(w), F.lit(0))).alias(f"{s}_below") for s in sums], *[f"{s}_all" for s in sums if totals])
