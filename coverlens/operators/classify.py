"""Decision functions over endpoint summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_endpoint(mean: Column, lo: Column, hi: Column, equivalent: Column, margin: float) -> Column:
    return (F.when((mean >= margin) & (lo > 0), "IMPROVED").when((mean <= -margin) & (hi < 0), "WORSENED")
            .when(F.coalesce(equivalent, F.lit(False)), "EQUIVALENT").otherwise("INCONCLUSIVE"))


def classify_joint(a: Column, b: Column) -> Column:
    either = lambda s: (a == s) | (b == s)
    return (F.when(either("WORSENED"), "WORSENING").when(either("IMPROVED"), "IMPROVEMENT")
            .when((a == "EQUIVALENT") & (b == "EQUIVALENT"), "EQUIVALENT").otherwise("INCONCLUSIVE"))


def verdict(det: dict[str, Column], rm: dict[str, Column], d_l: Column, margin_det: float, margin_rm: float, l_min: float) -> Column:
    """Six states from mean, 95 % and 90 % limits of both endpoints and the mean coverage gain."""
    no = F.lit(False)
    imp = lambda e, m: F.coalesce((e["mean"] >= m) & (e["lo95"] > 0), no)
    wor = lambda e, m: F.coalesce((e["mean"] <= -m) & (e["hi95"] < 0), no)
    eq = lambda e, m: F.coalesce((e["lo90"] > -m) & (e["hi90"] < m), no)
    good = imp(det, margin_det) | imp(rm, margin_rm)
    bad = wor(det, margin_det) | wor(rm, margin_rm)
    same = eq(det, margin_det) & eq(rm, margin_rm)
    return (F.when(bad & ~good, "RED").when(good & ~bad, "GREEN").when(good & bad, "MIXED")
            .when(same & (d_l >= l_min), "INTERMEDIATE").when(same, "NO_BENEFIT").otherwise("INCONCLUSIVE"))


def state_shares(states: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    """Counts and shares of each state per group."""
    names = ["IMPROVEMENT", "WORSENING", "EQUIVALENT", "INCONCLUSIVE"]
    g = states.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in names])
    return g.withColumn("non_adverse_fraction", 1 - F.col("n_worsening") / F.col("n"))


def generalization_gate(effects: DataFrame, global_rows: DataFrame, min_non_adverse: int, min_positive: int, expected_clusters: int | None = None) -> DataFrame:
    """GENERALIZES / HETEROGENEOUS / LIMITED from cluster states and the global endpoint rows (mean, ci_lo, margin, classification)."""
    e = effects.agg(F.count_if(F.col("state") != "WORSENING").alias("non_adverse"), F.count_if(F.col("state") == "IMPROVEMENT").alias("positive"), F.count("*").alias("clusters"))
    g = global_rows.agg(F.bool_or(F.col("mean") > 0).alias("p"), F.bool_and(F.col("classification") != "WORSENED").alias("w"),
                        F.bool_and(F.coalesce(F.col("ci_lo") >= -F.col("margin"), F.lit(False))).alias("l")).select(F.struct("*")).scalar()
    e = e.withColumn("_g", g).select("non_adverse", "positive", "clusters", F.col("_g.p").alias("global_mean_positive"), F.col("_g.w").alias("global_not_worse"), F.col("_g.l").alias("lower_ok"))
    valid = F.lit(True) if expected_clusters is None else F.col("clusters") == expected_clusters
    return e.withColumn("gate", F.when(valid & (F.col("non_adverse") >= min_non_adverse) & (F.col("positive") >= min_positive) & F.col("lower_ok"), "GENERALIZES")
                        .when(valid & F.col("global_mean_positive") & F.col("global_not_worse"), "HETEROGENEOUS").otherwise("LIMITED"))


def robustness_gate(summary: DataFrame, curve: str, green: Column | int = 2) -> DataFrame:
    """ROBUST / SENSITIVE / FRAGILE from the shares of states over all conditions and per curve."""
    adverse = summary.groupBy(curve).agg(F.avg((F.col("state") == "WORSENING").cast("int")).alias("a")).agg(F.bool_or(F.col("a") >= 0.5)).scalar()
    both = (F.col("dPdet_mean") > 0) & (F.col("dRMST_rel_mean") > 0)
    s = summary.agg(F.avg((F.col("state") != "WORSENING").cast("int")).alias("non_adverse"), F.avg(both.cast("int")).alias("both_positive"),
                    F.avg((F.col("state") == "IMPROVEMENT").cast("int")).alias("practical_improvement"))
    s = s.withColumn("adverse_half", adverse)
    g = green if isinstance(green, Column) else F.lit(green)
    return s.withColumn("gate", F.when((g < 2) | F.col("adverse_half"), "FRAGILE")
                        .when((F.col("non_adverse") >= 0.75) & (F.col("both_positive") >= 0.6) & (F.col("practical_improvement") >= 0.6), "ROBUST").otherwise("SENSITIVE"))


def two_thirds(n: Column) -> Column:
    return F.ceil(2 * n / 3)


def attrition_gate(states: DataFrame, level: str, comparator: str, geometric: str, online: str, online_geometric: str, fair: Column | None = None) -> DataFrame:
    """Per level, how many clusters reach a state for each comparator; the verdict needs two thirds of them at every level of the table. A
    comparator without a row at some level does not pass there."""
    per = states.groupBy(comparator, level).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "EQUIVALENT").alias("e"), F.count_if(F.col("state") == "IMPROVEMENT").alias("i"),
                                                F.count_if(F.col("state") == "WORSENING").alias("w"))
    need = two_thirds(F.col("n"))
    levels = states.agg(F.count_distinct(level)).scalar()

    def at(c: str, cond: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(F.col(comparator) == c, cond)) & (F.count_if(F.col(comparator) == c) == F.max("_levels")), F.lit(False))

    per = per.withColumn("_levels", levels)
    g = per.agg((at(geometric, F.col("w") == 0) & at(online, F.col("w") == 0)).alias("no_worsening"), at(geometric, F.col("e") >= need).alias("geometric_equivalent"),
                at(online, F.col("e") >= need).alias("online_equivalent"), at(online_geometric, F.col("i") >= need).alias("online_improved"),
                at(online, F.col("e") + F.col("i") >= need).alias("online_ok"), at(geometric, F.col("e") + F.col("i") >= need).alias("geometric_ok"))
    ok = F.lit(True) if fair is None else fair
    return g.withColumn("gate", F.when(~ok, "INVALID").when(F.col("geometric_equivalent"), "PIZZA_GAP_CLOSED").when(F.col("online_equivalent") & F.col("online_improved"), "ONLINE_REPLANNING_MAIN")
                        .when(F.col("no_worsening") & F.col("online_ok") & F.col("geometric_ok"), "GRACEFUL_REPLANNING").otherwise("NO_DIFFERENTIAL_ADVANTAGE"))


def mismatch_gate(states: DataFrame, level: str) -> DataFrame:
    """INVERTS on any worsening, ROBUST_TO_MODERATE_MISMATCH when two thirds improve at every level, else DEGRADES."""
    per = states.groupBy(level).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "IMPROVEMENT").alias("i"), F.count_if(F.col("state") == "WORSENING").alias("w"))
    g = per.agg(F.bool_or(F.col("w") > 0).alias("any_worsening"), F.bool_and(F.col("i") >= two_thirds(F.col("n"))).alias("all_improved"), F.count("*").alias("levels"))
    return g.withColumn("gate", F.when(F.col("any_worsening"), "INVERTS").when(F.col("all_improved"), "ROBUST_TO_MODERATE_MISMATCH").otherwise("DEGRADES"))


def mobility_gate(states: DataFrame, model: str, hashes_ok: Column) -> DataFrame:
    """PASS / BOUNDARY / FAIL by the share of models that improve without any worsening; INVALID when shared draws differ."""
    per = states.groupBy(model).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "IMPROVEMENT").alias("i"), F.count_if(F.col("state") == "WORSENING").alias("w"))
    g = per.agg(F.count("*").alias("models"), F.count_if((F.col("w") == 0) & (F.col("i") >= two_thirds(F.col("n")))).alias("passing"), F.bool_or(F.col("w") >= two_thirds(F.col("n"))).alias("any_bad"))
    return g.withColumn("gate", F.when(~hashes_ok, "INVALID").when(F.col("any_bad"), "FAIL").when(F.col("passing") >= two_thirds(F.col("models")), "PASS").otherwise("BOUNDARY"))


def sign_flip(effects: DataFrame, cluster: str, level: str, low, high, value: str, min_flips: int = 2) -> DataFrame:
    """Whether the mean effect, or that of enough clusters, changes sign between two levels (missing counts as zero)."""
    m = effects.where(F.col(level).isin(low, high)).groupBy(cluster).agg(
        F.avg(F.when(F.col(level) == low, F.col(value))).alias("lo"), F.avg(F.when(F.col(level) == high, F.col(value))).alias("hi"))
    zero = F.lit(0.0)
    flips = F.signum(F.coalesce("lo", zero)) != F.signum(F.coalesce("hi", zero))
    g = m.agg(F.avg("lo").alias("mean_low"), F.avg("hi").alias("mean_high"), F.count_if(flips).alias("flips"))
    return g.withColumn("boundary", (F.signum(F.coalesce("mean_low", zero)) != F.signum(F.coalesce("mean_high", zero))) | (F.col("flips") >= min_flips))


def scenario_flags(states: DataFrame, rules: dict[str, list[tuple[str, str, str, bool]]]) -> DataFrame:
    """Named booleans over (contrast, endpoint) classifications: each rule is a conjunction of (contrast, endpoint, state, wanted)."""
    def term(contrast, endpoint, state, wanted):
        s = F.coalesce(F.max(F.when((F.col("contrast") == contrast) & (F.col("endpoint") == endpoint), F.col("classification"))), F.lit("INCONCLUSIVE"))
        return (s == state) if wanted else (s != state)

    return states.agg(*[reduce(lambda a, b: a & b, [term(*t) for t in terms]).alias(name) for name, terms in rules.items()])
