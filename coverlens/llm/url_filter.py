"""URL filters: allow and block rules, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and public suffix. Each level shrinks to the one above through a
beta-binomial prior whose mean is the parent's posterior mean and whose strength is estimated from the spread of its children by the
method of moments. A page without a rule is blocked when the lower bound of its host's posterior bad rate exceeds a limit.

Only built-in functions. Counts are aggregated before the shuffle, so a host with a third of all pages sends one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MAX_BAD = 0.5
Z = 1.645
STRENGTH = (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and starts the path; null if none fits."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        where, slash, start = text.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + start)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad, mean, bound) from labelled pages (host, bad 0/1); bound is the posterior mean less z posterior deviations."""
    suffix, domain = F.substring_index("host", ".", -1), F.substring_index("host", ".", -2)
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k")).withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    total = suffixes.agg(((F.sum("sk") + 1) / (F.sum("sn") + 2)).alias("m0"))
    s = shrink(suffixes.withColumn("m0", total.scalar()), "sk", "sn", "m0", "s")
    d = shrink(domains.join(s.select("suffix", "s_mean"), "suffix"), "dk", "dn", "s_mean", "d")
    h = shrink(hosts.join(d.select("domain", "d_mean"), "domain"), "k", "n", "d_mean", "h")
    a, b = F.col("h_mean") * F.col("h_size"), (1 - F.col("h_mean")) * F.col("h_size")
    sd = F.sqrt(a * b / (F.col("h_size") * F.col("h_size") * (F.col("h_size") + 1)))
    return h.select("host", "n", F.col("k").alias("bad"), F.col("h_mean").alias("mean"), (F.col("h_mean") - z * sd).alias("bound"))


def shrink(df: DataFrame, k: str, n: str, prior: str, name: str) -> DataFrame:
    """Adds name_mean and name_size, the mean and weight of each posterior.

    The prior's weight m solves Var(k/n) = p(1-p) (1/n + (1 - 1/n) / (m + 1)) summed over all rows, clipped to STRENGTH."""
    p, nn, kk = F.col(prior), F.col(n).cast("double"), F.col(k).cast("double")
    spread = nn * (kk / nn - p) * (kk / nn - p)
    base = p * (1 - p)
    sums = df.agg(F.sum(spread).alias("_s"), F.sum(base).alias("_b"), F.sum(base * (nn - 1)).alias("_w"))
    rho = F.when(F.col("_w") > 0, (F.col("_s") - F.col("_b")) / F.col("_w")).otherwise(F.lit(0.0))
    m = F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(STRENGTH[1]))))
    df = df.withColumn("_m", sums.select(m.alias("_m")).scalar())
    return df.withColumns({f"{name}_size": nn + F.col("_m"), f"{name}_mean": (kk + F.col("_m") * p) / (nn + F.col("_m"))}).drop("_m")


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, id_col: str = "page_id") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bound.

    Without a rule a page is blocked if its host's bound exceeds max_bad; hosts without labels have no bound and are allowed. A null
    url or one without :// has empty host and path, fits no rule and is allowed. `outcomes` holds host and bad of labelled pages; it may
    be empty. Repeated rows stay; other columns are not read."""
    rows = pages.select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = reputation(outcomes.where("host <> ''")).select("host", "bound")
    own = F.when(F.col("bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, "host", "left").select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("bound", 6).alias("bound"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page's document id ends its path; the page is bad if any label of that document says low quality or toxic."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(bad)
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)(\\\\.html)?/?$', 1), '') AS bigint)")
    rows = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("host", number.alias("doc_id"))
    return rows.join(known, "doc_id").select("host", "bad")


def shrink_sql(name: str, source: str, k: str, n: str, prior: str) -> str:
    """CTE of `shrink` over a relation with counts k and n and a prior mean."""
    return f"""{name}_m AS (SELECT least({STRENGTH[1]}, greatest({STRENGTH[0]}, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {STRENGTH[1]} END)) m FROM (
  SELECT CASE WHEN sum({prior} * (1 - {prior}) * ({n} - 1)) > 0
    THEN (sum({n} * pow({k} / {n} - {prior}, 2)) - sum({prior} * (1 - {prior}))) / sum({prior} * (1 - {prior}) * ({n} - 1)) ELSE 0 END rho FROM {source})),
{name} AS (SELECT *, {n} + m {name}_size, ({k} + m * {prior}) / ({n} + m) {name}_mean FROM {source}, {name}_m)"""


def twin_sql(rules=RULES) -> str:
    """DuckDB statement with the rows of url_filter over pages and labels."""
    fits = []
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        where, slash, start = text.partition("/")
        fits.append((text, what, f"(host = '{where}' OR ends_with(host, '.{where}')) AND starts_with(path, '{slash + start}')"))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for t, _, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{w}'" for _, w, c in fits) + f" WHEN bound > {MAX_BAD} THEN 'block' ELSE 'allow' END"
    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
outcomes AS (SELECT host, bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]+)(\\.html)?/?$', 1), '') AS BIGINT) doc_id FROM p) JOIN known USING (doc_id) WHERE host <> ''),
hosts AS (SELECT host, count(*)::DOUBLE n, sum(bad)::DOUBLE k, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix FROM outcomes GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) dn, sum(k) dk FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(dn) sn, sum(dk) sk FROM domains GROUP BY ALL),
s0 AS (SELECT *, (sum(sk) OVER () + 1) / (sum(sn) OVER () + 2) m0 FROM suffixes),
{shrink_sql("s", "s0", "sk", "sn", "m0")},
d0 AS (SELECT domains.*, s_mean FROM domains JOIN s USING (suffix)),
{shrink_sql("d", "d0", "dk", "dn", "s_mean")},
h0 AS (SELECT hosts.*, d_mean FROM hosts JOIN d USING (domain)),
{shrink_sql("h", "h0", "k", "n", "d_mean")},
known_hosts AS (SELECT host, h_mean - {Z} * sqrt(h_mean * (1 - h_mean) / (h_size + 1)) bound FROM h)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, round(bound, 6) AS bound FROM p LEFT JOIN known_hosts USING (host)"""
