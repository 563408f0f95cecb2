"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """Round every double column so that summation order cannot show.

    As in SQL it is the product with the power of ten that is rounded, not the number's decimal text: the two part at halves of the last digit.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "double":
            unit = 10.0 ** special.get(f.name, digits)
            c = F.when(F.abs(c * unit) < float("inf"), F.round(c * unit) / unit).otherwise(c).alias(f.name)
        out.append(c)
    return df.select(*out)
