"""Stable fingerprints and hash-based uniforms (same draw wherever and whenever a task runs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """Uniform in [0, 1) from the first 52 bits of an md5 over the given parts; a double holds every such value exactly."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def stable_hash(*cols: str) -> Column:
    """sha256 of the compact JSON of the named columns in alphabetical key order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def trajectory_hash(pings: DataFrame, keys: list[str], t_max: int | None = None, width: int = 4096) -> DataFrame:
    """One fingerprint per key over its ordered positions, hashed chunk by chunk so no key is gathered whole."""
    p = pings if t_max is None else pings.where(F.col("t") <= t_max)
    item = F.concat_ws(",", "agent_id", "t", F.round(F.col("x") * 100).cast("bigint"), F.round(F.col("y") * 100).cast("bigint"))
    chunk = p.groupBy(*keys, "agent_id", F.floor(F.col("t") / width).alias("_c")).agg(
        F.md5(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("t", item.alias("i")))), lambda s: s["i"]))).alias("_h")
    )
    agent = chunk.groupBy(*keys, "agent_id").agg(
        F.md5(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("_c", "_h"))), lambda s: s["_h"]))).alias("_h")
    )
    # agents are hashed in ranges of their ids, so that no list holds all agents of a key
    part = agent.groupBy(*keys, F.floor(F.col("agent_id") / width).alias("_c")).agg(
        F.md5(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("agent_id", "_h"))), lambda s: s["_h"]))).alias("_h")
    )
    return part.groupBy(*keys).agg(
        F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("_c", "_h"))), lambda s: s["_h"])), 256).alias("trajectory_hash")
    )
