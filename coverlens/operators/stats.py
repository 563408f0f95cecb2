"""Statistical operators: native sufficient statistics first, a scalar tail per group last."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.functions import dist as D
from coverlens.functions.hashing import uniform
from coverlens.operators.exact_ranks import mann_whitney_exact as exact_mann_whitney
from coverlens.operators.exact_ranks import signed_rank_p
from coverlens.operators.quantiles import exact_quantiles
from coverlens.operators.scan import on_keys, sums_below, with_totals

P_FLOOR = 1e-16


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def cap_p(p: Column) -> Column:
    return F.greatest(p, F.lit(P_FLOOR))


def fmt_p(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p <= P_FLOOR, "< 1e-16").otherwise(F.format_string("%.2e", cap_p(p)))


def moments(df: DataFrame, keys: list[str], value: str, prefix: str = "") -> DataFrame:
    """n, mean, sd, se over the finite values, the row count and a flag that all were finite."""
    return moments_of(df, keys, {prefix: value})


def moments_of(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """The same for several prefixed values in one aggregate."""
    aggs = []
    for prefix, value in values.items():
        v = F.when(_finite(F.col(value)), F.col(value))
        aggs += [F.count(v).alias(f"{prefix}n"), F.avg(v).alias(f"{prefix}mean"), F.stddev_samp(v).alias(f"{prefix}sd"), F.count("*").alias(f"{prefix}n_total"),
                 F.count_if(v > 0).alias(f"{prefix}favorable_count"), F.count_if(v >= 0).alias(f"{prefix}non_adverse_count")]
    g = df.groupBy(*keys).agg(*aggs)
    return g.withColumns({c: e for p in values for c, e in (
        (f"{p}se", F.col(f"{p}sd") / F.sqrt(f"{p}n")), (f"{p}finite", F.col(f"{p}n") == F.col(f"{p}n_total")))})


def add_ci(m: DataFrame, confidence: float = 0.95, prefix: str = "", lo: str = "ci_lo", hi: str = "ci_hi") -> DataFrame:
    """Student-t interval from n, mean, sd, se; a constant sample gives its mean, fewer than two values give null."""
    n, mean, sd, se = (F.col(f"{prefix}{c}") for c in ("n", "mean", "sd", "se"))
    m = m.withColumn("_q", D.t_ppf_udf(F.lit((1 + confidence) / 2), F.when(n >= 2, n - 1)))
    half = F.when(sd == 0, 0.0).otherwise(F.col("_q") * se)
    return m.withColumns({f"{prefix}{lo}": mean - half, f"{prefix}{hi}": mean + half}).drop("_q")


def mean_ci(df: DataFrame, keys: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    return add_ci(moments(df, keys, value), confidence)


def add_tost(m: DataFrame, margin: float, alpha: float = 0.05, prefix: str = "") -> DataFrame:
    """Two one-sided tests against +-margin; needs two or more values, all finite, and a positive margin."""
    n, mean, sd, se = (F.col(f"{prefix}{c}") for c in ("n", "mean", "sd", "se"))
    ok = F.col(f"{prefix}finite") & (n >= 2) & F.lit(margin > 0 and math.isfinite(margin))
    spread = F.when(ok & (sd > 0), se)
    m = m.withColumns({"_pl": D.t_sf_udf((mean + margin) / spread, (n - 1).cast("double")), "_pu": D.t_sf_udf(-(mean - margin) / spread, (n - 1).cast("double"))})
    low = F.when(ok & (sd == 0), F.when(mean > -margin, 0.0).otherwise(1.0)).otherwise(F.col("_pl"))
    upp = F.when(ok & (sd == 0), F.when(mean < margin, 0.0).otherwise(1.0)).otherwise(F.col("_pu"))
    m = m.withColumns({f"{prefix}tost_p_lower": low, f"{prefix}tost_p_upper": upp})
    p1, p2 = F.col(f"{prefix}tost_p_lower"), F.col(f"{prefix}tost_p_upper")
    eq = (p1 < alpha) & (p2 < alpha) & (mean > -margin) & (mean < margin)
    return m.withColumns({f"{prefix}tost_p_max": F.when(p1.isNotNull() & p2.isNotNull(), F.greatest(p1, p2)), f"{prefix}equivalent": F.coalesce(eq, F.lit(False))}).drop("_pl", "_pu")


def tost(df: DataFrame, keys: list[str], value: str, margin: float, alpha: float = 0.05) -> DataFrame:
    return add_tost(add_ci(moments(df, keys, value), 0.90, lo="ci90_lo", hi="ci90_hi"), margin, alpha)


def paired_summary(df: DataFrame, keys: list[str], value: str, margin: float, confidence: float = 0.95) -> DataFrame:
    return add_tost(add_ci(moments(df, keys, value), confidence), margin)


def holm(df: DataFrame, family: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p (monotone, at most 1) and rejection flags; a family is one short list of hypotheses."""
    o = Window.partitionBy(*family).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*family))
    raw = (m - F.row_number().over(o) + 1) * F.col(p)
    out = df.withColumn("_raw", raw)
    adj = F.least(F.lit(1.0), F.max("_raw").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("p_holm", adj).withColumn("reject", F.col("p_holm") < alpha).drop("_raw")


def rank_label(r: Column) -> Column:
    """Magnitude labels of a rank effect at .147, .33 and .474."""
    a = F.abs(r)
    return F.when(r.isNull() | F.isnan(r), "n/a").when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")


def d_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(d.isNull() | F.isnan(d), "n/a").when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def _signed_ranks(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Distinct non-zero |d| of each key with counts, positive counts and mid-ranks."""
    v = df.where(F.col(diff).isNotNull() & ~F.isnan(diff) & (F.col(diff) != 0)).groupBy(*keys, F.abs(F.col(diff)).alias("_v")).agg(
        F.count("*").alias("_n"), F.count_if(F.col(diff) > 0).alias("_p"))
    return sums_below(v, keys, "_v", ["_n"]).withColumn("_rank", F.col("_n_below") + (F.col("_n") + 1) / 2)


def rank_biserial(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Signed-rank sums of the non-zero differences, tie term and matched-pairs rank-biserial correlation.

    Ranks come from counts of distinct |d| with a chunked scan, never from sorting a group in one task.
    """
    n = df.where(F.col(diff).isNotNull() & ~F.isnan(diff)).groupBy(*keys).agg(F.count("*").alias("n"))
    rank = F.col("_rank")
    g = _signed_ranks(df, keys, diff).groupBy(*keys).agg(F.sum("_n").alias("n_nonzero"), F.sum(F.col("_p") * rank).alias("w_plus"), F.sum((F.col("_n") - F.col("_p")) * rank).alias("w_minus"),
                             F.sum(F.col("_n").cast("double") * F.col("_n") * F.col("_n") - F.col("_n")).alias("tie_term"))
    j = on_keys(n, g, keys, "left").fillna(0, ["n_nonzero"])
    rb = F.coalesce((F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")), F.lit(0.0))
    return j.withColumns({"statistic": F.least("w_plus", "w_minus"), "rank_biserial": rb, "magnitude": rank_label(rb)})


def wilcoxon_paired(df: DataFrame, keys: list[str], diff: str, method: str = "normal") -> DataFrame:
    """Two-sided signed-rank test of the non-zero differences by the method that the caller names, the same for every group.

    ``normal``: tie-corrected normal approximation. ``exact``: the distribution over all signs of the mid-ranks, ties included, as rows that
    are multiplied pairwise; its terms grow with the square of a group, so it is for groups the caller knows to be of moderate size.
    """
    r = rank_biserial(df, keys, diff)
    n = F.col("n_nonzero").cast("double")
    if method == "exact":
        r = on_keys(r, signed_rank_p(_signed_ranks(df, keys, diff), r, keys), keys, "left")
    elif method == "normal":
        var = (n * (n + 1) * (2 * n + 1) - F.col("tie_term") / 2) / 24
        z = (F.col("statistic") - n * (n + 1) / 4) / F.sqrt(var)
        r = r.withColumn("_p", D.norm_two_sided_udf(F.when(F.col("n_nonzero") > 0, z)))
    else:
        raise ValueError(f"unknown method {method!r}")
    return r.withColumn("p", F.when(F.col("n_nonzero") == 0, 1.0).otherwise(cap_p(F.col("_p")))).withColumn("method", F.lit(method)).drop("_p")


def friedman(df: DataFrame, by: list[str], block: list[str], arm: str, value: str, arms: list[str]) -> DataFrame:
    """Omnibus over complete blocks; needs three or more arms and two or more blocks. A block that repeats an arm raises."""
    k = len(arms)
    hold = lambda a: (F.col(arm) == a) & F.col(value).isNotNull()
    b = df.where(F.col(arm).isin(arms)).groupBy(*by, *block).agg(*[F.max(F.when(hold(a), F.col(value))).alias(f"_v{i}") for i, a in enumerate(arms)], *[F.count_if(hold(a)).alias(f"_n{i}") for i, a in enumerate(arms)])
    repeated = F.greatest(*[F.col(f"_n{i}") for i in range(k)], F.lit(0)) > 1
    complete = F.least(*[F.col(f"_n{i}") for i in range(k)], F.lit(1)) == 1
    b = b.where(F.when(repeated, F.raise_error(F.lit("block repeats an arm")).cast("boolean")).otherwise(complete))
    count = lambda i, test: sum((F.when(test(F.col(f"_v{j}"), F.col(f"_v{i}")), 1).otherwise(0) for j in range(k)), F.lit(0))
    cells = []
    for i, a in enumerate(arms):
        below, same = count(i, lambda x, y: x < y), count(i, lambda x, y: x == y)
        cells.append(F.struct(F.lit(a).alias("a"), (below + (same + 1) / 2).alias("r"), (same * same - 1).alias("t")))
    b = b.select(*by, F.explode(F.array(*cells)).alias("_r"))
    per = b.groupBy(*by, "_r.a").agg(F.sum("_r.r").alias("_R"), F.sum("_r.t").alias("_t"), F.count("*").alias("_n"))
    g = per.groupBy(*by).agg(F.sum(F.col("_R") * F.col("_R")).alias("_ss"), F.sum("_t").alias("_ties"), F.max("_n").alias("n_complete"))
    n = F.col("n_complete").cast("double")
    chi = (12 / (n * k * (k + 1)) * F.col("_ss") - 3 * n * (k + 1)) / (1 - F.col("_ties") / (n * k * (k * k - 1)))
    g = g.select(*by, "n_complete", F.when((n >= 2) & F.lit(k >= 3), chi).alias("chi2"))
    return g.withColumn("p", cap_p(D.chi2_sf_udf("chi2", F.lit(float(k - 1)))))


def _two_sample(df: DataFrame, keys: list[str], arm: str, a: str, b: str, value: str, weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    x = df.where(F.col(arm).isin(a, b) & F.col(value).isNotNull())
    v = x.groupBy(*keys, value).agg(F.sum(F.when(F.col(arm) == a, w).otherwise(0)).alias("_wa"), F.sum(F.when(F.col(arm) == b, w).otherwise(0)).alias("_wb"))
    r = sums_below(v, keys, value, ["_wb"])
    n = F.col("_wa") + F.col("_wb")
    return r.groupBy(*keys).agg(F.sum("_wa").alias("n_a"), F.sum("_wb").alias("n_b"), F.sum(F.col("_wa") * (F.col("_wb_below") + F.col("_wb") / 2)).alias("U"),
                                F.sum(n.cast("double") * n * n - n).alias("tie_term"))


def mann_whitney(df: DataFrame, keys: list[str], arm: str, a: str, b: str, value: str) -> DataFrame:
    """U of ``a`` over ``b``, two-sided p by the tie-corrected normal approximation with continuity correction."""
    g = _two_sample(df, keys, arm, a, b, value)
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("tie_term") / (n * (n - 1))))
    z = (F.greatest(F.col("U"), na * nb - F.col("U")) - na * nb / 2 - 0.5) / F.when(sd > 0, sd)
    return g.withColumn("p", cap_p(F.coalesce(F.when(z <= 0, 1.0).otherwise(D.norm_two_sided_udf(z)), F.lit(1.0)))).withColumn(
        "cliffs_delta", F.try_divide(2 * F.col("U"), na * nb) - 1)


def mann_whitney_exact(df: DataFrame, keys: list[str], arm: str, a: str, b: str, value: str) -> DataFrame:
    """U of ``a`` over ``b`` and its two-sided p over all ways to choose the smaller arm, ties included."""
    x = df.where(F.col(arm).isin(a, b) & F.col(value).isNotNull())
    v = x.groupBy(*keys, F.col(value).alias("_v")).agg(F.count_if(F.col(arm) == a).alias("_wa"), F.count_if(F.col(arm) == b).alias("_wb"))
    v = sums_below(v.withColumn("_all", F.col("_wa") + F.col("_wb")), keys, "_v", ["_all"]).withColumnRenamed("_all_below", "_below")
    return exact_mann_whitney(v, keys)


def cliffs_delta(df: DataFrame, keys: list[str], arm: str, a: str, b: str, value: str) -> DataFrame:
    """P(a > b) - P(a < b) from the U statistic, with its magnitude label."""
    g = _two_sample(df, keys, arm, a, b, value)
    dl = F.try_divide(2 * F.col("U"), F.col("n_a").cast("double") * F.col("n_b")) - 1
    return g.select(*keys, "n_a", "n_b", dl.alias("cliffs_delta"), rank_label(dl).alias("magnitude"))


def kruskal(df: DataFrame, keys: list[str], arm: str, value: str) -> DataFrame:
    """Unpaired rank omnibus with tie correction."""
    x = df.where(F.col(value).isNotNull()).groupBy(*keys, value, arm).agg(F.count("*").alias("_c"))
    r = sums_below(x.groupBy(*keys, value).agg(F.sum("_c").alias("_n")), keys, value, ["_n"])
    ranks = r.withColumns({"_rank": F.col("_n_below") + (F.col("_n") + 1) / 2, "_t": (F.col("_n").cast("double") * F.col("_n") * F.col("_n") - F.col("_n"))})
    ties = ranks.groupBy(*keys).agg(F.sum("_t").alias("_ties"), F.sum("_n").alias("n"))
    per = on_keys(x, ranks.select(*keys, value, "_rank"), keys + [value]).groupBy(*keys, arm).agg(F.sum(F.col("_c") * F.col("_rank")).alias("_R"), F.sum("_c").alias("_m"))
    g = on_keys(per.groupBy(*keys).agg(F.sum(F.col("_R") * F.col("_R") / F.col("_m")).alias("_s"), F.count("*").alias("groups")), ties, keys)
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_ties") / (n * n * n - n))
    return g.select(*keys, "groups", "n", h.alias("H")).withColumn("p", cap_p(D.chi2_sf_udf("H", (F.col("groups") - 1).cast("double"))))


def cohens_d(df: DataFrame, keys: list[str], arm: str, a: str, b: str, value: str) -> DataFrame:
    """Pooled-sd standardised difference; null under two values per arm or with no spread."""
    va, vb = F.when(F.col(arm) == a, F.col(value)), F.when(F.col(arm) == b, F.col(value))
    g = df.groupBy(*keys).agg(F.count(va).alias("n_a"), F.count(vb).alias("n_b"), F.avg(va).alias("mean_a"), F.avg(vb).alias("mean_b"), F.var_samp(va).alias("_va"), F.var_samp(vb).alias("_vb"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb")) / (F.col("n_a") + F.col("n_b") - 2))
    ok = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    dd = F.when(ok, (F.col("mean_a") - F.col("mean_b")) / F.nullif(pooled, F.lit(0.0)))
    return g.withColumn("cohens_d", dd).withColumn("d_magnitude", d_label(F.col("cohens_d"))).drop("_va", "_vb")


#: Cumulative Poisson(1) probabilities that turn a uniform into a resampling weight; what lies above the last is less than 2 ** -52, the step of `uniform`.
POISSON_CUM = list(accumulate(1 / math.factorial(i) / math.e for i in range(19)))


def poisson_weight(u: Column) -> Column:
    w = F.lit(0)
    for c in POISSON_CUM:
        w = w + F.when(u >= c, 1).otherwise(0)
    return w


def bootstrap_mean_ci(df: DataFrame, keys: list[str], value: str, row_id: list[str], iterations: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the mean with Poisson(1) weights: replicates are summed where the rows are, no resampled rows move."""
    x = df.where(F.col(value).isNotNull()).select(*keys, value, *[c for c in row_id if c not in keys], F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_b"))
    w = poisson_weight(uniform(seed, F.col("_b"), *[F.col(c) for c in row_id]))
    rep = x.withColumn("_w", w).groupBy(*keys, "_b").agg((F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    tail = (1 - confidence) / 2
    ci = rep.groupBy(*keys).agg(F.percentile("_m", tail).alias("ci_lo"), F.percentile("_m", 1 - tail).alias("ci_hi"))
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return on_keys(mean, ci, keys)


def _dense_index(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """0-based position of each distinct ``order`` value within its key."""
    return sums_below(df.withColumn("_one", F.lit(1)), keys, order, ["_one"]).withColumnRenamed("_one_below", name).drop("_one")


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: str, iterations: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """Equal-weight cluster means resampled with replacement; needs two clusters for an interval. ``cluster`` is numeric."""
    m = df.where(_finite(F.col(value))).groupBy(*by, cluster).agg(F.avg(value).alias("_m"))
    t = m.groupBy(*by).agg(F.count("*").alias("n_clusters"), F.avg("_m").alias("mean"))
    x = on_keys(_dense_index(m, by, cluster, "_i"), t.select(*by, F.col("n_clusters").alias("_n")), by)
    slots = x.where("_n >= 2").select(*by, F.col("_i").alias("_slot"), "_n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_b"))
    pick = F.floor(uniform(seed, F.col("_b"), F.col("_slot")) * F.col("_n"))
    rep = on_keys(slots.select(*by, "_b", pick.alias("_i")), x.select(*by, "_i", "_m"), by + ["_i"]).groupBy(*by, "_b").agg(F.avg("_m").alias("_r"))
    tail = (1 - confidence) / 2
    ci = rep.groupBy(*by).agg(F.percentile("_r", tail).alias("ci_lo"), F.percentile("_r", 1 - tail).alias("ci_hi"))
    return on_keys(t, ci, by, "left")


def hierarchical_bootstrap(df: DataFrame, cluster: str, unit: str, value: str, iterations: int, seed: int) -> DataFrame:
    """Clusters resampled, then units within each drawn cluster; interval of the mean of cluster means."""
    e = df.where(F.col(value).isNotNull()).select(cluster, unit, value)
    cl = e.groupBy(cluster).agg(F.count("*").alias("_nu"))
    cl = with_totals(_dense_index(cl, [], cluster, "_ci"), [], {"_nc": F.count("*")})
    un = _dense_index(e, [cluster], unit, "_ui")
    un = un.join(cl.select(cluster, "_ci"), cluster).select("_ci", "_ui", value)
    slots = cl.select(F.col("_ci").alias("_slot"), "_nc", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_b"))
    drawn = slots.select("_b", "_slot", F.floor(uniform(seed, F.col("_b"), F.col("_slot")) * F.col("_nc")).alias("_ci")).join(cl.select("_ci", "_nu"), "_ci")
    seeds = drawn.select("_b", "_slot", "_ci", "_nu", F.explode(F.sequence(F.lit(0), F.col("_nu").cast("int") - 1)).alias("_j"))
    seeds = seeds.withColumn("_ui", F.floor(uniform(seed, F.col("_b"), F.col("_slot"), F.col("_j")) * F.col("_nu")))
    rep = seeds.join(un, ["_ci", "_ui"]).groupBy("_b", "_slot").agg(F.avg(value).alias("_m")).groupBy("_b").agg(F.avg("_m").alias("_r"))
    ci = rep.agg(F.percentile("_r", 0.025).alias("ci_lower"), F.percentile("_r", 0.975).alias("ci_upper"))
    s = e.agg(F.avg(value).alias("interaction_mean"), F.count("*").alias("n_cells"))
    n = cl.agg(F.count("*")).scalar()
    lo, hi = ci.select("ci_lower").scalar(), ci.select("ci_upper").scalar()
    return s.select("interaction_mean", lo.alias("ci_lower"), hi.alias("ci_upper"), n.alias("n_clusters"), "n_cells")


def cliffs_delta_ci(df: DataFrame, keys: list[str], arm: str, a: str, b: str, value: str, row_id: list[str], iterations: int, seed: int,
                    confidence: float = 0.95, paired: bool = False) -> DataFrame:
    """Bootstrap se and interval of Cliff's delta with Poisson weights; ``paired`` gives both arms of a row id the same weight."""
    x = df.where(F.col(arm).isin(a, b)).select(*keys, arm, value, *[c for c in row_id if c not in keys], F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_b"))
    parts = [F.col(c) for c in row_id] + ([] if paired else [F.col(arm)])
    x = x.withColumn("_w", poisson_weight(uniform(seed, F.col("_b"), *parts))).where("_w > 0")
    g = _two_sample(x, keys + ["_b"], arm, a, b, value, F.col("_w"))
    dl = F.try_divide(2 * F.col("U"), F.col("n_a").cast("double") * F.col("n_b")) - 1
    tail = (1 - confidence) / 2
    ci = g.withColumn("_d", dl).groupBy(*keys).agg(F.stddev_samp("_d").alias("se"), F.percentile("_d", tail).alias("ci_lo"), F.percentile("_d", 1 - tail).alias("ci_hi"))
    return on_keys(cliffs_delta(df, keys, arm, a, b, value), ci, keys)


def cliff_equivalence(ci90: DataFrame, margin: float = 0.147) -> DataFrame:
    return ci90.withColumn("equivalent", (F.col("ci_lo") > -margin) & (F.col("ci_hi") < margin))


def levene(df: DataFrame, keys: list[str], arm: str, value: str) -> DataFrame:
    """Brown-Forsythe: one-way F on absolute deviations from the exact arm medians."""
    med = exact_quantiles(df, keys + [arm], value, {"_med": 0.5})
    z = on_keys(df.select(*keys, arm, value), med, keys + [arm]).withColumn("_z", F.abs(F.col(value) - F.col("_med")))
    s = z.groupBy(*keys, arm).agg(F.count("_z").alias("_n"), F.avg("_z").alias("_m"), F.var_pop("_z").alias("_v"))
    g = s.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("_n") * F.col("_m")).alias("_s"),
                             F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("_q"), F.sum(F.col("_n") * F.col("_v")).alias("_w"))
    between = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")
    f = (F.col("n") - F.col("groups")) / (F.col("groups") - 1) * between / F.nullif(F.col("_w"), F.lit(0.0))
    g = g.select(*keys, "n", "groups", f.alias("W"))
    return g.withColumn("p", cap_p(D.f_sf_udf("W", (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double"))))


def normality_jb(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Jarque-Bera from native skewness and kurtosis (another test than Shapiro-Wilk; same question)."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    return g.withColumn("jb", jb).withColumn("p", cap_p(F.exp(-F.col("jb") / 2)))


def achieved_power(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Power of each (cohens_d, n_a, n_b) row."""
    return effects.withColumn("power", F.when(F.col("cohens_d").isNotNull(), D.power_udf(F.abs("cohens_d"), "n_a", "n_b", F.lit(alpha))))


def min_detectable(effects: DataFrame, alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    return effects.withColumn("min_detectable_d", D.min_detectable_udf("n_a", "n_b", F.lit(alpha), F.lit(target)))


def mixed_model(df: DataFrame, cluster: str, y: str, x: dict[str, Column], reml: bool = True, rounds: int = 5, points: int = 33) -> DataFrame:
    """Random-intercept model by profile likelihood over the variance ratio, from one row of sums per cluster.

    Rows are read once into per-cluster cross products, kept in the checkpoint folder. Each round evaluates a fixed grid of ratios (a
    constant number of sums per ratio) and hands the next one its best ratio, a single number. Output: one row with the coefficients, variances, ICC, log-likelihood and the ratio test against
    no cluster effect. Slopes that vary by cluster are not fitted.
    """
    from coverlens.session import cut_lineage

    s, names = _cluster_sums(df, cluster, y, x)
    s, k = cut_lineage(s), len(names)
    lo, hi = math.log(1e-6), math.log(1e4)
    for _ in range(rounds):
        fits = _evaluate(s, F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")), points, k, reml)
        best = fits.agg(F.max_by(F.struct("*"), "llf").alias("_b")).select("_b.*")
        centre, step = math.log(best.select("ratio").first()[0]), (hi - lo) / (points - 1)
        lo, hi = centre - step, centre + step  # one grid step on both sides
    null = _evaluate(s, None, 1, k, reml).select("llf").scalar()
    ratio = F.col("ratio")
    out = best.select(*[F.get("beta", i).alias(n) for i, n in enumerate(names)], "sigma2", (ratio * F.col("sigma2")).alias("tau2"),
                      (ratio / (1 + ratio)).alias("icc"), "llf", (2 * F.greatest(F.lit(0.0), F.col("llf") - null)).alias("lrt"), ratio.alias("ratio"), "n", "n_clusters")
    return out.withColumn("lrt_p", cap_p(D.chi2_sf_udf("lrt", F.lit(1.0)) / 2))


def _cluster_sums(df: DataFrame, cluster: str, y: str, x: dict[str, Column]):
    names = ["Intercept", *x]
    cols = [F.lit(1.0), *[c.cast("double") for c in x.values()]]
    d = df.select(cluster, F.col(y).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(cols)]).where("_y IS NOT NULL")
    k = len(names)
    aggs = [F.count("*").alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_y")).alias("yy")]
    aggs += [F.sum(f"_x{i}").alias(f"sx{i}") for i in range(k)] + [F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"xy{i}") for i in range(k)]
    aggs += [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"xx{i}_{j}") for i in range(k) for j in range(i, k)]
    return d.groupBy(cluster).agg(*aggs), names


def _evaluate(s: DataFrame, spec, points: int, k: int, reml: bool) -> DataFrame:
    if spec is None:
        g = s.withColumns({"ratio": F.lit(0.0), "lo": F.lit(0.0), "hi": F.lit(0.0)})
    else:
        g = s.withColumn("_sp", spec).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        g = g.withColumns({"lo": F.col("_sp.lo"), "hi": F.col("_sp.hi"), "ratio": F.exp(F.col("_sp.lo") + (F.col("_sp.hi") - F.col("_sp.lo")) * F.col("_i") / (points - 1))})
    w = F.col("ratio") / (1 + F.col("n") * F.col("ratio"))
    a = [F.sum(F.col(f"xx{i}_{j}") - w * F.col(f"sx{i}") * F.col(f"sx{j}")) for i in range(k) for j in range(i, k)]
    b = [F.sum(F.col(f"xy{i}") - w * F.col(f"sx{i}") * F.col("sy")) for i in range(k)]
    sums = g.groupBy("ratio", "lo", "hi").agg(F.array(*a).alias("a"), F.array(*b).alias("b"), F.sum(F.col("yy") - w * F.col("sy") * F.col("sy")).alias("c"),
                                              F.sum(F.log1p(F.col("n") * F.col("ratio"))).alias("ld"), F.sum("n").alias("n"), F.count("*").alias("n_clusters"))

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = np.zeros((k, k))
                m[np.triu_indices(k)] = r.a
                m = m + np.triu(m, 1).T
                beta = np.linalg.solve(m, np.asarray(r.b))
                rss = max(r.c - float(np.dot(r.b, beta)), 1e-300)
                dof = r.n - k if reml else r.n
                s2 = rss / dof
                ll = -0.5 * (dof * (math.log(2 * math.pi * s2) + 1) + r.ld + (np.linalg.slogdet(m)[1] if reml else 0.0))
                rows.append((r.ratio, r.lo, r.hi, beta.tolist(), s2, ll, r.n, r.n_clusters))
            yield pd.DataFrame(rows, columns=["ratio", "lo", "hi", "beta", "sigma2", "llf", "n", "n_clusters"])

    return sums.mapInPandas(solve, "ratio double, lo double, hi double, beta array<double>, sigma2 double, llf double, n long, n_clusters long")


def cluster_effects(df: DataFrame, cluster: str, y: str, x: dict[str, Column], fit: DataFrame) -> DataFrame:
    """Predicted cluster intercepts (shrunken residual means) of a fitted mixed model."""
    s, names = _cluster_sums(df, cluster, y, x)
    one = fit.select(F.struct("ratio", *names).alias("_f")).scalar()
    s = s.withColumn("_f", one)
    resid = F.col("sy")
    for i, n in enumerate(names):
        resid = resid - F.col(f"sx{i}") * F.col(f"_f.{n}")
    return s.select(cluster, "n", (F.col("_f.ratio") / (1 + F.col("n") * F.col("_f.ratio")) * resid).alias("blup"))
