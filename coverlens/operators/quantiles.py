"""Exact quantiles without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.operators.scan import sums_below


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key (null values ignored), one column per entry of ``probs``."""
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    r = sums_below(v, keys, value, ["_n"], totals=True).withColumnRenamed("_n_all", "_total")
    first, last = F.col("_n_below"), F.col("_n_below") + F.col("_n")
    picks = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(p)
        lo, hi = F.floor(h), F.ceil(h)
        picks += [
            F.max(F.when((first <= lo) & (lo < last), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi < last), F.col(value))).alias(f"_hi_{name}"),
        ]
    g = r.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(p)
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (h - F.floor(h))).alias(name))
    return g.select(*keys, *out)
