"""Readers, writers and ingest transforms."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlens.schemas import POINT
from coverlens.session import checkpoint_dir


def read_runs(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Run tables in CSV (plain or gz) with a declared schema; malformed rows fail."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nullValue", "none").csv(paths)


def coerce_numeric(df: DataFrame, columns: list[str], sentinel: str = "none") -> DataFrame:
    """Text columns to DOUBLE; the sentinel and anything unreadable become null."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)).try_cast("double") for c in columns})


def union_runs(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of run tables with a ``source`` tag; columns a part lacks become null."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def read_parquet_tagged(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several Parquet files as one table with the file each row came from."""
    return spark.read.option("mergeSchema", True).parquet(*paths).withColumn("source", F.element_at(F.split(F.input_file_name(), "/"), -1))


GEOJSON = T.StructType([
    T.StructField("grid_id", T.StringType()), T.StructField("climate", T.StringType()), T.StructField("environment_type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([T.StructField("id", T.StringType()), T.StructField("feature_type", T.StringType()), T.StructField("area_probability", T.DoubleType())])),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))]))),
])


def parse_features(df: DataFrame, column: str) -> DataFrame:
    """Feature-collection JSON text to one row per feature: top-level metadata, properties and points.

    A line's coordinates are its points; a polygon's points are its outer ring.
    """
    f = df.select(F.from_json(column, GEOJSON).alias("g")).select("g.grid_id", "g.climate", "g.environment_type", F.explode("g.features").alias("f"))
    line = F.from_json("f.geometry.coordinates", "array<array<double>>")
    ring = F.get(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"), 0)
    xy = F.when(F.col("f.geometry.type") == "Polygon", ring).otherwise(line)
    pts = F.transform(xy, lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y"))).cast(T.ArrayType(POINT))
    return f.select("grid_id", "climate", "environment_type", F.col("f.properties.id").alias("feature_id"), F.col("f.properties.feature_type").alias("feature_type"),
                    F.col("f.properties.area_probability").alias("area_probability"), F.col("f.geometry.type").alias("geom_type"), pts.alias("pts"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON feature collections, one collection per file, read in parallel over files."""
    return parse_features(spark.read.text(path, wholetext=True), "value")


def latest_campaign(configs: DataFrame, stage: str = "stage", timestamp: str = "timestamp", directory: str = "directory", has_runs: Column | None = None) -> DataFrame:
    """Newest campaign directory per stage (ties by directory name) among those with a runs file."""
    c = configs if has_runs is None else configs.where(has_runs)
    return c.groupBy(stage).agg(F.max(F.struct(timestamp, directory)).alias("m")).select(stage, F.col(f"m.{directory}").alias(directory), F.col(f"m.{timestamp}").alias(timestamp))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "append", **options) -> None:
    """Result tables by the commit protocol, partitioned for later pruning."""
    w = df.write.mode(mode).format(fmt).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def flatten_runs(df: DataFrame, nested: list[str]) -> DataFrame:
    """Struct columns to top-level columns."""
    return df.select(*[c for c in df.columns if c not in nested], *[f"{n}.*" for n in nested])


def stamp_provenance(df: DataFrame, config: dict[str, str], columns: list[str], sentinel: str = "none") -> DataFrame:
    """Add the provenance columns a table lacks from the config, fill gaps with the sentinel, hash the condition."""
    out = df
    for c in columns:
        if c == "condition_key_hash":
            continue
        have = F.col(c).cast("string") if c in df.columns else F.lit(config.get(c)).cast("string")
        out = out.withColumn(c, F.coalesce(have, F.lit(sentinel)))
    if "condition_key_hash" in columns:
        out = out.withColumn("condition_key_hash", F.sha2(F.col("condition_key"), 256))
    return out


def pending_design(design: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Design rows without a finished run."""
    return design.join(done.select(*keys), keys, "left_anti")


def design_grid(base: DataFrame, factors: dict[str, list]) -> DataFrame:
    """Every base row times every combination of the (short, literal) factor lists, generated in place."""
    for name, levels in factors.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    return base


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256"))
