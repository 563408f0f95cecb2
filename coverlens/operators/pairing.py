"""Pairing, contrasts and pivots. Paired shapes come from one conditional aggregate per key, so each reads and shuffles once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.operators.scan import on_keys, with_next, with_totals

# Columns that identify a trial when present.
ID_CANDIDATES = ("dataset", "trial", "seed", "n_drones", "num_drones", "n_agents", "budget_km", "budget", "victim_model", "fov", "fov_deg")

# Base column of each paired endpoint; RMST endpoints are control minus method over the horizon.
ENDPOINTS = {
    "dPdet": "P_detect", "dRMST_rel": "RMST", "dPostFaultGain": "PostFault_PdetGain", "dConditionalGain": "ConditionalPostFaultPdet",
    "dPdet_Tref": "P_detect_at_Tref", "dRMST_rel_Tref": "RMST_at_Tref",
}
T_REF = 8000.0


def detect_keys(df: DataFrame, arm: str = "planning_mode") -> list[str]:
    return [c for c in ID_CANDIDATES if c in df.columns and c != arm]


def _of(arm: str, name: str, c: str, required: bool = False) -> Column:
    """The value of ``c`` in the row of one arm; raises where a key repeats the arm, or lacks it if ``required``.

    The guard is part of every value, so selecting fewer columns cannot drop it."""
    n = F.count_if(F.col(arm) == name)
    value = F.max(F.when(F.col(arm) == name, F.col(c)))
    guard = F.raise_error(F.lit("pairing key is not unique per arm or lacks one" if required else "pairing key is not unique per arm"))
    return F.when(n != 1 if required else n > 1, guard).otherwise(value)


def paired_matrix(df: DataFrame, keys: list[str], arm: str, arms: list[str], metric: str, agg: str = "first") -> DataFrame:
    """One row per key, one column per arm. ``first`` demands one value per cell and raises otherwise; ``avg`` averages."""
    if not keys:
        raise ValueError("paired_matrix needs at least one key column")
    val = lambda a: F.when(F.col(arm) == a, F.col(metric))
    if agg == "avg":
        return df.groupBy(*keys).agg(*[F.avg(val(a)).alias(a) for a in arms])
    g = df.groupBy(*keys).agg(*[F.max(val(a)).alias(a) for a in arms], *[F.count(val(a)).alias(f"_n_{a}") for a in arms])
    clash = F.greatest(*[F.col(f"_n_{a}") for a in arms], F.lit(0)) > 1
    guard = lambda a: F.when(clash, F.raise_error(F.lit("pairing key is not unique per arm")).cast("double")).otherwise(F.col(a)).alias(a)
    return g.select(*keys, *[guard(a) for a in arms])


def paired_contrasts(df: DataFrame, keys: list[str], control: str, method: str, arm: str = "planning_mode", metadata: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Method against control per trial; positive is better for the method. Incomplete or repeated trials raise.

    ``carry`` columns come back per arm, ``metadata`` columns only where a trial has a single value.
    """
    two = df.where(F.col(arm).isin(control, method))
    cols = ["P_detect", "RMST", "L", "H_common", *carry]
    g = two.groupBy(*keys).agg(*[_of(arm, control, c, True).alias(f"_c_{c}") for c in cols], *[_of(arm, method, c, True).alias(f"_m_{c}") for c in cols],
                               *[F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in metadata])
    h = F.greatest("_c_H_common", "_m_H_common")
    d_p = F.col("_m_P_detect") - F.col("_c_P_detect")
    return g.select(*keys, d_p.alias("dPdet"), ((F.col("_c_RMST") - F.col("_m_RMST")) / h).alias("dRMST_rel"), (F.col("_m_L") - F.col("_c_L")).alias("dL"), h.alias("H_common"),
                    *[F.col(f"_c_{c}").alias(f"{c}_control") for c in carry], *[F.col(f"_m_{c}").alias(f"{c}_method") for c in carry], *metadata)


def paired_diff(df: DataFrame, keys: list[str], endpoint: str, method: str, control: str, arm: str = "planning_mode") -> DataFrame:
    """(keys, diff) for a named endpoint or a plain metric; pairs with a null side are dropped."""
    base = ENDPOINTS.get(endpoint, endpoint)
    pick = [_of(arm, method, base).alias("_m"), _of(arm, control, base).alias("_c")]
    if endpoint == "dRMST_rel":
        pick.append(_of(arm, method, "H_common").alias("_h"))
    g = df.where(F.col(arm).isin(method, control)).groupBy(*keys).agg(*pick)
    diff = {"dRMST_rel": lambda: (F.col("_c") - F.col("_m")) / F.col("_h"), "dRMST_rel_Tref": lambda: (F.col("_c") - F.col("_m")) / (T_REF + 1)}.get(
        endpoint, lambda: F.col("_m") - F.col("_c"))()
    return g.select(*keys, diff.alias("diff")).where("diff IS NOT NULL AND NOT isnan(diff)")


def retention(df: DataFrame, keys: list[str], is_base: Column, value: str = "P_detect", loss: str = "NRMST") -> DataFrame:
    """value / value of the key's base row (null with a reason without a positive base), loss minus the base loss."""
    base = df.where(is_base).select(*keys, F.col(value).alias("_bp"), F.col(loss).alias("_bl"))
    j = on_keys(df, base, keys, "left")
    reason = F.when(F.col("_bp").isNull(), "no_k0_baseline").when(F.col("_bp") <= 0, "baseline_P_detect_zero").otherwise("none")
    return j.withColumns({f"retention_{value}": F.when(F.col("_bp") > 0, F.col(value) / F.col("_bp")), "retention_invalid_reason": reason,
                          f"degradation_{loss}": F.col(loss) - F.col("_bl")}).drop("_bp", "_bl")


def retention_contrasts(df: DataFrame, keys: list[str], first: str, second: str, arm: str = "planning_mode") -> DataFrame:
    """Retention, degradation and endpoint differences of two arms; positive favours the first."""
    cols = ["retention_P_detect", "degradation_NRMST", "P_detect", "RMST", "H_common"]
    g = df.where(F.col(arm).isin(first, second)).groupBy(*keys).agg(*[_of(arm, first, c).alias(f"_a_{c}") for c in cols], *[_of(arm, second, c).alias(f"_b_{c}") for c in cols])
    a, b = (lambda c: F.col(f"_a_{c}")), (lambda c: F.col(f"_b_{c}"))
    return g.select(*keys, (a("retention_P_detect") - b("retention_P_detect")).alias("dRetention_Pdet"), (b("degradation_NRMST") - a("degradation_NRMST")).alias("dDegradation_NRMST"),
                    (a("P_detect") - b("P_detect")).alias("dPdet"), ((b("RMST") - a("RMST")) / F.greatest(a("H_common"), b("H_common"))).alias("dRMST_rel"))


def arm_pairs(df: DataFrame, keys: list[str], arm: str, pairs: list[tuple[str, str]], values: list[str], require: bool = False) -> DataFrame:
    """(keys, first, second, a_*, b_*) for a fixed list of arm pairs, from one row of arm values per key."""
    arms = sorted({x for p in pairs for x in p})
    g = df.where(F.col(arm).isin(arms)).groupBy(*keys).agg(
        *[_of(arm, x, v).alias(f"_{i}_{v}") for i, x in enumerate(arms) for v in values], *[F.count_if(F.col(arm) == x).alias(f"_{i}_n") for i, x in enumerate(arms)])
    at = {x: i for i, x in enumerate(arms)}
    items = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), *[F.col(f"_{at[a]}_{v}").alias(f"a_{v}") for v in values], *[F.col(f"_{at[b]}_{v}").alias(f"b_{v}") for v in values],
                      ((F.col(f"_{at[a]}_n") > 0) & (F.col(f"_{at[b]}_n") > 0)).alias("ok")) for a, b in pairs]
    out = g.select(*keys, F.explode(F.array(*items)).alias("_p")).select(*keys, "_p.*")
    if require:
        return out.where(F.when(F.col("ok"), True).otherwise(F.raise_error(F.lit("missing arm in pair")).cast("boolean"))).drop("ok")
    return out.where("ok").drop("ok")


def all_pairs_contrasts(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], arm: str = "planning_mode") -> DataFrame:
    p = arm_pairs(df, keys, arm, pairs, ["P_detect", "RMST", "L", "H_common"], require=True)
    return p.select(*keys, "first", "second", (F.col("a_P_detect") - F.col("b_P_detect")).alias("dPdet"), ((F.col("b_RMST") - F.col("a_RMST")) / F.greatest("a_H_common", "b_H_common")).alias("dRMST_rel"),
                    (F.col("a_L") - F.col("b_L")).alias("dL"))


def asof_sample(curve: DataFrame, keys: list[str], order: str, value: str, at: float) -> DataFrame:
    """Last value at or before ``at`` per key."""
    return curve.where(F.col(order) <= at).groupBy(*keys).agg(F.max_by(value, order).alias(f"{value}_at"), F.max(order).alias(f"{order}_at"))


def interp_curve(curve: DataFrame, keys: list[str], x: str, y: str, step: float, stop: float) -> DataFrame:
    """Each curve linearly interpolated on 0, step, ..., stop, clamped at both ends. Every interval emits its own grid points."""
    c = with_next(curve.select(*keys, x, y), keys, x, [x, y])
    c = with_totals(c, keys, {"_first": F.min(x)})
    top = int(stop // step)
    i0 = F.when(F.col(x) == F.col("_first"), F.lit(0)).otherwise(F.ceil(F.col(x) / step).cast("int"))
    nx = F.col(f"next_{x}")
    i1 = F.when(nx.isNull(), F.lit(top)).otherwise(F.ceil(nx / step).cast("int") - 1)
    c = c.withColumns({"_i0": F.greatest(i0, F.lit(0)), "_i1": F.least(i1, F.lit(top))}).where("_i0 <= _i1")
    c = c.withColumn("_i", F.explode(F.sequence("_i0", "_i1"))).withColumn("grid", F.col("_i") * F.lit(float(step)))
    f = (F.col("grid") - F.col(x)) / (nx - F.col(x))
    v = F.when(nx.isNull() | (F.col("grid") <= F.col(x)), F.col(y)).otherwise(F.col(y) + f * (F.col(f"next_{y}") - F.col(y)))
    return c.select(*keys, "grid", v.alias(y))


def interp_mean_curve(curve: DataFrame, keys: list[str], by: list[str], x: str, y: str, step: float, stop: float) -> DataFrame:
    return interp_curve(curve, keys, x, y, step, stop).groupBy(*by, "grid").agg(F.avg(y).alias(f"mean_{y}"), F.count("*").alias("n"))


def padded_curve(curve: DataFrame, keys: list[str], by: list[str], step: str, y: str) -> DataFrame:
    """Curves of a group padded with their last value to the longest one; ``step`` is a dense 0-based index."""
    ends = curve.groupBy(*keys).agg(F.max(step).alias("_end"), F.max_by(y, step).alias("_last"))
    tail = with_totals(ends, by, {"_max": F.max("_end")}).where("_end < _max")
    tail = tail.select(*keys, F.explode(F.sequence(F.col("_end") + 1, F.col("_max"))).alias(step), F.col("_last").alias(y))
    return curve.select(*keys, step, y).unionByName(tail)


def post_event_efficiency(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Mass gained after the event per unit of distance; curves without post-event samples are skipped."""
    post = F.col("distance_post_fault") > 0
    g = curve.groupBy(*keys).agg(F.count_if(post).alias("_n"), F.max_by("L_cumulative", "step").alias("L_end"), F.max_by("distance_post_fault", "step").alias("postfault_distance"),
                                 F.coalesce(F.max_by(F.when(F.col("distance_post_fault") == 0, F.col("L_cumulative")), F.when(F.col("distance_post_fault") == 0, F.col("step"))), F.lit(0.0)).alias("L_at_fault_curve"),
                                 F.min_by(F.when(post, F.col("L_cumulative")), F.when(post, F.col("step"))).alias("L_postfault_first_sample")).where("_n > 0")
    gain = F.col("L_end") - F.col("L_at_fault_curve")
    return g.select(*keys, "L_at_fault_curve", "L_postfault_first_sample", "L_end", gain.alias("postfault_mass_gain"), "postfault_distance",
                    F.when(F.col("postfault_distance") > 0, gain / F.col("postfault_distance")).alias("postfault_mass_efficiency"))


def factorial_contrasts(df: DataFrame, keys: list[str], metric: str, s1: str, s3: str, d1: str, d3: str, arm: str = "planning_mode") -> DataFrame:
    """Simple effects and interaction of a 2 x 2 design: short/long horizon, static/dynamic."""
    w = paired_matrix(df, keys, arm, [s1, s3, d1, d3], metric)
    a, b, c, e = (F.col(x) for x in (s1, s3, d1, d3))
    return w.select(*keys, (c - a).alias("D1"), (e - b).alias("D3"), ((e - b) - (c - a)).alias("I"), (b - a).alias("H_S"), (e - c).alias("H_D"))


def code_factors(df: DataFrame, mapping: dict[str, tuple[int, int]], arm: str = "planning_mode") -> DataFrame:
    """Arm names to two 0/1 factors; an unknown arm raises."""
    m = F.create_map(*[v for k, (d, h) in mapping.items() for v in (F.lit(k), F.struct(F.lit(d).alias("d"), F.lit(h).alias("h")))])
    hit = F.try_element_at(m, F.col(arm))
    bad = F.raise_error(F.concat(F.lit("unknown arm: "), F.col(arm))).cast("int")
    return df.withColumns({c: F.when(hit.isNull(), bad).otherwise(hit[c[0]]) for c in ("dynamism", "horizon")})


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that raises when a key repeats on either side."""
    guard = lambda d: with_totals(d, keys, {"_n": F.count("*")}).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("key is not one to one")).cast("int")))
    l, r = guard(left).where("_n IS NULL").drop("_n"), guard(right).where("_n IS NULL").drop("_n")
    return on_keys(l, r, keys, "left")


def cluster_means(df: DataFrame, cluster: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*cluster).agg(*[F.avg(v).alias(f"mean_{v}") for v in values], F.count("*").alias("n"))


def semi_keys(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    return on_keys(df, keys_df.select(*keys), keys, "left_semi")


def common_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))
