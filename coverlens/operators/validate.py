"""Validation, integrity and fairness checks: predicates over groups, counted in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.operators.pairing import _of
from coverlens.operators.scan import on_keys


def validate_pairs(df: DataFrame, keys: list[str], arm: str, expected: list[str]) -> DataFrame:
    """One row per pairing cell: whether an arm repeats and whether the arms are not exactly the expected ones, once each."""
    c = df.groupBy(*keys, arm).agg(F.count("*").alias("_n"))
    hit = lambda a: F.count_if((F.col(arm) == a) & (F.col("_n") == 1)) == 1
    complete = reduce(lambda x, y: x & y, [hit(a) for a in expected])
    return c.groupBy(*keys).agg((F.max("_n") > 1).alias("duplicate"), (~(complete & (F.count("*") == len(expected)))).alias("incomplete"), F.count("*").alias("arms"))


def pair_status(cells: DataFrame) -> DataFrame:
    d, i = F.count_if("duplicate"), F.count_if("incomplete")
    return cells.agg(F.count("*").alias("n_cells"), d.alias("duplicate_cells"), i.alias("incomplete_cells"), ((d == 0) & (i == 0)).alias("valid"))


def _bad_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def validate_runs(df: DataFrame, required: list[str], endpoints: list[str], probabilities: list[str], expected_rows: int | None = None) -> DataFrame:
    """Row count, missing columns, nulls, non-finite endpoints, probabilities outside [0, 1], overall validity."""
    missing = [c for c in required if c not in df.columns]
    zero = F.lit(0).cast("bigint")
    add = lambda cs: reduce(lambda a, b: a + b, cs, zero)
    g = df.agg(F.count("*").alias("rows"), add([F.count_if(F.col(c).isNull()) for c in df.columns]).alias("nulls"),
               add([F.count_if(_bad_number(F.col(c).cast("double"))) for c in endpoints if c in df.columns]).alias("non_finite"),
               add([F.count_if((F.col(c) < 0) | (F.col(c) > 1)) for c in probabilities if c in df.columns]).alias("out_of_range"))
    ok = (F.col("nulls") == 0) & (F.col("non_finite") == 0) & (F.col("out_of_range") == 0) & F.lit(not missing)
    if expected_rows is not None:
        ok = ok & (F.col("rows") == expected_rows)
    return g.withColumns({"missing_columns": F.lit(len(missing)), "valid": ok})


def profile_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows, distinct count per key column, duplicate keys, missing values, range of a value.

    The key columns are reduced to their distinct combinations before anything is counted distinctly.
    """
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    k = df.groupBy(*keys).agg(F.count("*").alias("_n"), nulls.alias("_z"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return k.agg(F.sum("_n").alias("rows"), *[F.countDistinct(c).alias(f"n_{c}") for c in keys], F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_z").alias("missing_values"),
                 F.min("_lo").alias("value_min"), F.max("_hi").alias("value_max"))


def _constant(c: str) -> Column:
    """At least one value and all equal, without a distinct count."""
    return F.coalesce(F.min(c) == F.max(c), F.lit(False))


def fairness_checks(df: DataFrame, keys: list[str], equal: list[str], step_bound: float | None = None, step: str = "max_step_distance", exhausted: Column | None = None) -> DataFrame:
    """Per trial: each named column constant, step bound kept, no early path exhaustion."""
    aggs = [_constant(c).alias(f"{c}_equal") for c in equal]
    if step_bound is not None:
        aggs += [F.max(step).alias("max_step"), F.bool_and(F.col(step) <= step_bound + 1e-6).alias("step_bound_ok")]
    if exhausted is not None:
        aggs.append(F.bool_or(exhausted).alias("invalid_path_exhaustion"))
    return df.groupBy(*keys).agg(*aggs)


def fairness_vs_baseline(df: DataFrame, keys: list[str], arm: str, baseline: str, equal: list[str]) -> DataFrame:
    """Each non-baseline row against the baseline arm of its own trial: named fields equal, baseline present."""
    base = df.where(F.col(arm) == baseline).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in equal], F.lit(True).alias("_has"))
    j = on_keys(df.where(F.col(arm) != baseline), base, keys, "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in equal])
    return j.groupBy(arm).agg(F.count("*").alias("rows"), F.count_if(F.col("_has").isNull()).alias("missing_baseline"), F.count_if(F.col("_has") & ~same).alias("violations"))


def row_constraints(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(constraint, violations, holds): every rule counted in one aggregate; an unknown outcome is a violation."""
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(n).alias("violations")) for n in rules])).alias("_r")
    return one.select(rows).select("_r.*").withColumn("holds", F.col("violations") == 0)


def group_constraints(df: DataFrame, keys: list[str], size: int, shared: list[str]) -> DataFrame:
    """Groups, groups of another size, groups whose shared columns differ."""
    g = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[_constant(c).alias(c) for c in shared])
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("_n") != size).alias("bad_size"), *[F.count_if(~F.col(c)).alias(f"bad_{c}") for c in shared])


def consistency_audit(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Rows missing on either side, repeated keys, values apart by more than the tolerance, largest difference."""
    l = left.groupBy(*keys).agg(F.count("*").alias("_nl"), *[F.min(c).alias(f"_l_{c}") for c in columns])
    r = right.groupBy(*keys).agg(F.count("*").alias("_nr"), *[F.min(c).alias(f"_r_{c}") for c in columns])
    diffs = [F.abs(F.col(f"_l_{c}") - F.col(f"_r_{c}")) for c in columns]
    worst = F.greatest(*diffs) if len(diffs) > 1 else diffs[0]
    j = l.join(r, keys, "full").withColumn("_d", worst)
    both = F.col("_nl").isNotNull() & F.col("_nr").isNotNull()
    return j.agg(F.count_if(F.col("_nl").isNull()).alias("missing_left"), F.count_if(F.col("_nr").isNull()).alias("missing_right"),
                 F.count_if((F.coalesce("_nl", F.lit(0)) > 1) | (F.coalesce("_nr", F.lit(0)) > 1)).alias("duplicate_keys"), F.count_if(both).alias("matched"),
                 F.count_if(both & (F.col("_d") > tolerance)).alias("mismatches"), F.max(F.when(both, F.col("_d"))).alias("max_abs_diff"))


def row_count_contract(df: DataFrame, contract: DataFrame, key: str) -> DataFrame:
    """Actual rows against the declared ``expected_rows`` per campaign."""
    c = df.groupBy(key).agg(F.count("*").alias("rows"))
    j = contract.select(key, "expected_rows").join(c, key, "full")
    j = j.withColumns({"rows": F.coalesce("rows", F.lit(0)), "expected_rows": F.coalesce("expected_rows", F.lit(0))})
    return j.select(key, "rows", "expected_rows", (F.col("rows") == F.col("expected_rows")).alias("matches"))


def manifest_diff(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) for missing, extra and changed artifacts; both sides have (path, sha256)."""
    j = actual.withColumnRenamed("sha256", "_a").join(manifest.withColumnRenamed("sha256", "_m"), "path", "full")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_m").isNull(), "extra").when(F.col("_a") != F.col("_m"), "changed")
    return j.select("path", status.alias("status")).where("status IS NOT NULL")


def invariance_check(df: DataFrame, keys: list[str], by: str, metric: str, tolerance: float = 1e-9) -> DataFrame:
    """Share of keys whose metric is the same at every level of the remaining factor, per arm."""
    g = df.groupBy(*keys, by).agg((F.max(metric) - F.min(metric) <= tolerance).alias("_same"), F.count("*").alias("_n")).where("_n > 1")
    return g.groupBy(by).agg(F.count("*").alias("cells"), F.avg(F.col("_same").cast("int")).alias("identical_fraction"))


def pre_event_identity(df: DataFrame, keys: list[str], arm: str, a: str, b: str, value: str, exact: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Whether two arms agree before the event: value within the tolerance, hash and step columns equal. A trial that repeats an arm raises."""
    pick = lambda c, x: _of(arm, x, c)
    w = df.groupBy(*keys).agg(F.abs(pick(value, a) - pick(value, b)).alias("_d"), *[(pick(c, a) == pick(c, b)).alias(c) for c in exact])
    return w.agg(F.max("_d").alias("max_abs_diff"), F.bool_and(F.coalesce(F.col("_d") < tolerance, F.lit(False))).alias("value_all_equal"),
                 *[F.bool_and(F.coalesce(c, F.lit(False))).alias(f"{c}_all_equal") for c in exact], F.count("*").alias("trials"))


def finite_check(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    ok = reduce(lambda a, b: a & b, [~_bad_number(F.col(c)) for c in columns])
    return df.groupBy(by).agg(F.bool_and(ok).alias("all_finite"), F.count("*").alias("n"))
