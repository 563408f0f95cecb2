"""Aggregations and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.operators import stats as S
from coverlens.operators.classify import classify_endpoint, classify_joint, verdict
from coverlens.operators.pairing import arm_pairs
from coverlens.operators.quantiles import exact_quantiles
from coverlens.operators.scan import on_keys, sums_below, with_totals

MARGIN_PDET = 0.01
MARGIN_RMST_REL = 0.02


def describe_arms(df: DataFrame, by: list[str], value: str) -> DataFrame:
    g = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return g.withColumn("se", F.col("std") / F.sqrt("n"))


def descriptives(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sd, median, quartiles and their range, all exact."""
    q = exact_quantiles(df, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return on_keys(describe_arms(df, by, value), q, by).withColumn("iqr", F.col("q75") - F.col("q25"))


def summary_ci(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and 1.96 standard errors of several metrics."""
    aggs = [a for v in values for a in (F.avg(v).alias(f"mean_{v}"), (1.96 * F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"ci_{v}"))]
    return df.groupBy(*by).agg(*aggs, F.count("*").alias("n"))


def summary_table(contrasts: DataFrame, by: list[str], pdet_margin: float = MARGIN_PDET, rmst_margin: float = MARGIN_RMST_REL) -> DataFrame:
    """Per group and endpoint: n, mean, sd, se, t interval, sign counts, TOST; joint state. Both endpoints share one aggregate pass."""
    m = S.moments_of(contrasts, by, {"dPdet_": "dPdet", "dRMST_rel_": "dRMST_rel"})
    for name, margin in (("dPdet", pdet_margin), ("dRMST_rel", rmst_margin)):
        m = S.add_tost(S.add_ci(m, 0.95, f"{name}_"), margin, 0.05, f"{name}_")
        m = m.withColumn(f"{name}_state", classify_endpoint(F.col(f"{name}_mean"), F.col(f"{name}_ci_lo"), F.col(f"{name}_ci_hi"), F.col(f"{name}_equivalent"), margin))
    return m.withColumn("state", classify_joint(F.col("dPdet_state"), F.col("dRMST_rel_state")))


def global_summary(means: DataFrame, endpoint: str, cluster: str, value: str, margin: float, iterations: int, seed: int) -> DataFrame:
    """Cluster-level endpoint row: mean, bootstrap interval, TOST over cluster means and the resulting class."""
    b = S.cluster_bootstrap(means, [], cluster, value, iterations, seed)
    t = S.add_tost(S.moments(means.groupBy(cluster).agg(F.avg(value).alias("_m")), [], "_m"), margin)
    j = on_keys(b, t.select("sd", "equivalent"), [])
    return j.withColumns({"endpoint": F.lit(endpoint), "margin": F.lit(margin), "classification": classify_endpoint(F.col("mean"), F.col("ci_lo"), F.col("ci_hi"), F.col("equivalent"), margin)})


def operational_summary(contrasts: DataFrame, by: list[str], pdet_margin: float = 0.01, rmst_margin: float = 0.02, l_min: float = 0.01) -> DataFrame:
    """Means, sds, 95 and 90 % intervals and the six-state verdict per group."""
    m = S.moments_of(contrasts, by, {"dPdet_": "dPdet", "dRMST_rel_": "dRMST_rel", "_l_": "dL"})
    keep, ends = [], {}
    for name in ("dPdet", "dRMST_rel"):
        m = S.add_ci(S.add_ci(m, 0.95, f"{name}_", "ci95_lo", "ci95_hi"), 0.90, f"{name}_", "ci90_lo", "ci90_hi")
        ends[name] = {"mean": F.col(f"{name}_mean"), "lo95": F.col(f"{name}_ci95_lo"), "hi95": F.col(f"{name}_ci95_hi"), "lo90": F.col(f"{name}_ci90_lo"), "hi90": F.col(f"{name}_ci90_hi")}
        keep += [f"{name}_{c}" for c in ("n", "mean", "sd", "ci95_lo", "ci95_hi", "ci90_lo", "ci90_hi", "favorable_count")]
    m = m.withColumn("mean_dL", F.col("_l_mean"))
    return m.withColumn("verdict", verdict(ends["dPdet"], ends["dRMST_rel"], F.col("mean_dL"), pdet_margin, rmst_margin, l_min)).select(*by, *keep, "mean_dL", "verdict")


def response_surface(contrasts: DataFrame, by: list[str]) -> DataFrame:
    return contrasts.groupBy(*by).agg(F.avg("dPdet").alias("mean_dPdet"), F.avg("dRMST_rel").alias("mean_dRMST_rel"), F.avg("dL").alias("mean_dL"), F.count("*").alias("n"))


def delta_summary(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """Mean, median and maximum absolute change, share changed by more than 1e-6."""
    a = df.withColumn("_a", F.abs(delta))
    m = a.groupBy(*by).agg(F.count("*").alias("n"), F.avg(delta).alias("mean_delta"), F.max("_a").alias("max_abs_delta"), F.avg((F.col("_a") > 1e-6).cast("int")).alias("pct_changed"))
    return on_keys(m, exact_quantiles(a, by, "_a", {"median_abs_delta": 0.5}), by)


def timing_summary(df: DataFrame, arm: str, fleet: str) -> DataFrame:
    """Planner time by horizon (the number before 'step' in the arm name) and fleet."""
    h = df.withColumn("horizon", F.regexp_extract(arm, r"(\d+)step", 1).try_cast("int"))
    g = h.groupBy("horizon", fleet).agg(F.count("*").alias("n"), F.avg("planner_wall_time").alias("planner_wall_time_mean"), F.stddev_samp("planner_wall_time").alias("planner_wall_time_sd"),
                                        F.avg("number_of_replans").alias("replans_mean"))
    return g.withColumn("planner_ms_per_replan", 1000.0 * F.col("planner_wall_time_mean") / F.col("replans_mean"))


def overhead(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Percent over the smallest group mean."""
    g = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return with_totals(g, [], {"_min": F.min("mean")}).select(*by, "mean", "n", ((F.col("mean") / F.col("_min") - 1) * 100).alias("overhead_pct"))


def crossover_point(df: DataFrame, level: str, arm: str, slow: str, fast: str, value: str) -> DataFrame:
    """Smallest level at which the mean of ``slow`` exceeds that of ``fast``."""
    g = df.groupBy(level).agg(F.avg(F.when(F.col(arm) == slow, F.col(value))).alias("_s"), F.avg(F.when(F.col(arm) == fast, F.col(value))).alias("_f"))
    g = g.withColumn("ratio", F.try_divide("_s", "_f"))
    return g.agg(F.min(F.when(F.col("ratio") > 1, F.col(level))).alias("crossover"), F.count("ratio").alias("levels"), F.max("ratio").alias("max_ratio"))


def saturation_curve(df: DataFrame, param: str, arm: str, a: str, b: str, value: str) -> DataFrame:
    """Two arms at every parameter value: means, effect size, U and p, winner or tie."""
    d = S.cohens_d(df, [param], arm, a, b, value).where("n_a > 0 AND n_b > 0")
    u = S.mann_whitney(df, [param], arm, a, b, value).select(param, "U", "p")
    j = on_keys(d, u, [param]).withColumn("delta_mean", F.col("mean_a") - F.col("mean_b"))
    return j.withColumn("winner", F.when(F.col("p") < 0.05, F.when(F.col("delta_mean") > 0, a).otherwise(b)).otherwise("tie"))


def wins_by_cluster(df: DataFrame, cluster: list[str], unit: list[str], arm: str, a: str, b: str, value: str, method: str = "normal") -> DataFrame:
    """Paired comparison of two arms inside each cluster with its winner (starred when p < .05)."""
    p = arm_pairs(df, cluster + unit, arm, [(a, b)], [value]).withColumn("_d", F.col(f"a_{value}") - F.col(f"b_{value}")).where("_d IS NOT NULL")
    m = p.groupBy(*cluster).agg(F.avg(f"a_{value}").alias("mean_a"), F.avg(f"b_{value}").alias("mean_b"))
    w = S.wilcoxon_paired(p, cluster, "_d", method).select(*cluster, F.col("n").alias("n_pairs"), "rank_biserial", "magnitude", "statistic", "p")
    j = on_keys(m, w, cluster).withColumn("delta_mean", F.col("mean_a") - F.col("mean_b"))
    j = j.withColumn("pct_rel", F.when(F.col("mean_b") != 0, 100 * F.col("delta_mean") / F.col("mean_b")))
    star = F.when(F.col("p") < 0.05, "*").otherwise("")
    return j.withColumn("winner", F.concat(F.when(F.col("delta_mean") > 0, a).otherwise(b), star))


def breakdown(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Counts, shares and means by category, largest first."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])
    return with_totals(g, [], {"_all": F.sum("n")}).withColumn("fraction", F.col("n") / F.col("_all")).drop("_all").orderBy(F.desc("n"), by)


def top_arms(df: DataFrame, arm: str, value: str, k: int) -> DataFrame:
    """The k arms with the highest mean (a top-k report)."""
    return df.groupBy(arm).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).orderBy(F.desc("mean"), arm).limit(k)


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    v = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    r = sums_below(v, by, value, ["_n"])
    return r.select(*by, value, (F.col("_n_below") + (F.col("_n") + 1) / 2).alias(name))


def association(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson, Spearman (on average ranks), least-squares slope and intercept.

    Ranks meet distinct pairs with their counts, never rows; the ranks of ``y`` are added up per value of ``x`` before they meet the
    ranks of ``x``, so a value of ``x`` that holds most rows is one row there."""
    d = df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    mid = on_keys(average_ranks(d, by, y, "_ry"), g.select(*by, ((F.col("n") + 1) / 2).alias("_mid")), by)
    pairs = on_keys(d.groupBy(*by, x, y).agg(F.count("*").alias("_n")), mid.select(*by, y, (F.col("_ry") - F.col("_mid")).alias("_ry")), by + [y])
    per = pairs.groupBy(*by, x).agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_ry")).alias("_s"), F.sum(F.col("_n") * F.col("_ry") * F.col("_ry")).alias("_yy"))
    rx = F.col("_n_below") + (F.col("_n") + 1) / 2 - F.col("_mid")
    per = on_keys(sums_below(per, by, x, ["_n"]), g.select(*by, ((F.col("n") + 1) / 2).alias("_mid")), by).withColumn("_rx", rx)
    r = per.groupBy(*by).agg(F.sum(F.col("_rx") * F.col("_s")).alias("_xy"), F.sum(F.col("_n") * F.col("_rx") * F.col("_rx")).alias("_xx"), F.sum("_yy").alias("_yy"))
    spearman = F.col("_xy") / F.nullif(F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy")), F.lit(0.0))
    return on_keys(g, r, by).select(*by, "n", "pearson", spearman.alias("spearman"), "slope", "intercept")


def rollup_means(df: DataFrame, cluster: str, by: list[str], value: str) -> DataFrame:
    """The same mean at cluster and at global grain, in one pass over grouping sets."""
    cols = [cluster, *by]
    g = df.groupingSets([cols, by], *cols).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.grouping(cluster).alias("_g"))
    return g.withColumn("grain", F.when(F.col("_g") == 1, "global").otherwise("cluster")).drop("_g")


def first_adverse_level(states: DataFrame, level: str, cluster: str) -> DataFrame:
    """Lowest level with a worsening cluster and how many clusters worsen there."""
    g = states.groupBy(level).agg(F.count_if(F.col("state") == "WORSENING").alias("worsening"), F.countDistinct(cluster).alias("clusters"))
    return g.agg(F.min(F.when(F.col("worsening") > 0, F.col(level))).alias("first_adverse"), F.min_by(F.when(F.col("worsening") > 0, F.col("worsening")), F.when(F.col("worsening") > 0, F.col(level))).alias("clusters"),
                 F.count("*").alias("levels"))


def gap_to_worst(df: DataFrame, study: str, arm: str, value: str) -> DataFrame:
    g = df.groupBy(study, arm).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    return with_totals(g, [study], {"_min": F.min("mean")}).withColumn("gap_pct", F.when(F.col("_min") > 0, 100 * (F.col("mean") - F.col("_min")) / F.col("_min"))).drop("_min")


def minmax_scale(df: DataFrame, by: list[str], arm: str, value: str) -> DataFrame:
    """Group means scaled to [0, 1] across arms; all 1 when constant."""
    g = df.groupBy(*by, arm).agg(F.avg(value).alias("mean"))
    t = with_totals(g, by, {"_lo": F.min("mean"), "_hi": F.max("mean")})
    return t.withColumn("scaled", F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col("mean") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))).drop("_lo", "_hi")


def pairwise_table(df: DataFrame, by: list[str], unit: list[str], arm: str, arms: list[str], value: str) -> DataFrame:
    """Every pair of arms: means, difference, signed-rank test, effect sizes, Holm over the pairs of a group."""
    pairs = [(a, b) for i, a in enumerate(arms) for b in arms[i + 1:]]
    p = arm_pairs(df, by + unit, arm, pairs, [value]).withColumn("_d", F.col(f"a_{value}") - F.col(f"b_{value}")).where("_d IS NOT NULL")
    k = by + ["first", "second"]
    a, b = f"a_{value}", f"b_{value}"
    m = p.groupBy(*k).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"))
    m = m.withColumn("cohens_d", (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt((F.col("_va") + F.col("_vb")) / 2), F.lit(0.0))).drop("_va", "_vb")
    w = S.wilcoxon_paired(p, k, "_d").select(*k, "n", "statistic", "rank_biserial", "magnitude", "p")
    j = on_keys(m, w, k).withColumns({"delta_mean": F.col("mean_a") - F.col("mean_b")})
    j = j.withColumn("pct_rel", F.when(F.col("mean_b") != 0, 100 * F.col("delta_mean") / F.col("mean_b")))
    return S.holm(j, by, "p")


def study_report(df: DataFrame, unit: list[str], arm: str, arms: list[str], baseline: str, value: str, paired: bool = True) -> DataFrame:
    """Per arm: descriptives, test against the baseline with Holm, and the omnibus test of the study.

    Paired studies use signed ranks and Friedman; where the trial key is not unique per arm use ``paired=False``: U test and Kruskal-Wallis.
    """
    d = df.where(F.col(arm).isin(arms))
    base = descriptives(d, [arm], value)
    others = [a for a in arms if a != baseline]
    if paired:
        p = arm_pairs(d, unit, arm, [(a, baseline) for a in others], [value]).withColumn("_d", F.col(f"a_{value}") - F.col(f"b_{value}")).where("_d IS NOT NULL")
        t = S.wilcoxon_paired(p, ["first"], "_d").select(F.col("first").alias(arm), "statistic", F.col("rank_biserial").alias("effect"), "p")
        om = S.friedman(d, [], unit, arm, value, arms).select(F.col("chi2").alias("omnibus"), F.col("p").alias("omnibus_p"))
    else:
        t = None
        for a in others:
            u = S.mann_whitney(d, [], arm, a, baseline, value).select(F.lit(a).alias(arm), F.col("U").alias("statistic"), F.col("cliffs_delta").alias("effect"), "p")
            t = u if t is None else t.unionByName(u)
        om = S.kruskal(d, [], arm, value).select(F.col("H").alias("omnibus"), F.col("p").alias("omnibus_p"))
    t = S.holm(t, [], "p")
    o = om.select(F.struct("*")).scalar()
    return on_keys(base, t, [arm], "left").withColumn("_o", o).select("*", F.col("_o.omnibus"), F.col("_o.omnibus_p")).drop("_o")
