"""Queries over the statistical operators."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import functions as F

from coverlens.operators import pairing as P
from coverlens.operators import stats as S
from coverlens.operators import summaries as M
from coverlens.plans.ctes import contrasts, runs, summary, t_quantile, t_sf, with_
from coverlens.plans.experiments import ARMS, CON, CON_K, KEYS, RUNS, RUNS_K, _con, _con_k, _runs, four_arms
from coverlens.plans.registry import query, rounded
from coverlens.sources import adapters as A


def phi2(z: str) -> str:
    """Two-sided normal tail by the odd-factorial series (exact to double precision for moderate z)."""
    x = f"greatest(abs({z}), 1e-12)"
    s = f"list_sum(list_transform(range(0, 200), lambda j: exp((2 * j + 1) * ln({x}) - lgamma(j + 1.5) - (j + 1) * ln(2) + 0.5 * ln(pi()))))"
    return f"greatest(1e-16, least(1.0, 2 * (0.5 - exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {s})))"


def signed_ranks(src: str, by: str, d: str) -> str:
    return f"""
sr0 AS (SELECT {by}, "{d}" AS d FROM {src} WHERE "{d}" IS NOT NULL),
sr1 AS (SELECT {by}, d, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {by}, abs(d)) AS c FROM sr0 WHERE d <> 0),
sr2 AS (SELECT {by}, count(*) AS n_nonzero, coalesce(sum(rk) FILTER (d > 0), 0) AS wp, coalesce(sum(rk) FILTER (d < 0), 0) AS wm, sum(c * c - 1) AS tt FROM sr1 GROUP BY {by}),
sr AS (SELECT * EXCLUDE (n_nonzero), coalesce(n_nonzero, 0) AS n_nonzero, least(wp, wm) AS w, coalesce((wp - wm) / (wp + wm), 0.0) AS rb FROM (SELECT {by}, count(*) AS n FROM sr0 GROUP BY {by}) LEFT JOIN sr2 USING ({by})),
wz AS (SELECT *, {phi2('((w - n_nonzero * (n_nonzero + 1) / 4.0) / sqrt((n_nonzero * (n_nonzero + 1) * (2.0 * n_nonzero + 1) - tt / 2.0) / 24.0))')} AS pz FROM sr)"""


LABEL = "CASE WHEN abs({0}) < 0.147 THEN 'negligible' WHEN abs({0}) < 0.33 THEN 'small' WHEN abs({0}) < 0.474 THEN 'medium' ELSE 'large' END"
SR_K = signed_ranks("con", "k", "dPdet")


@query("mean_ci", with_(RUNS_K, CON_K, """
m AS (SELECT k, count(*) AS n, avg("dPdet") AS mean, stddev_samp("dPdet") AS sd FROM con GROUP BY k)""", t_quantile("q95", "m", 0.975), select="""SELECT k, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(sd / sqrt(n), 9) AS se,
    round(mean - q * sd / sqrt(n), 8) AS ci_lo, round(mean + q * sd / sqrt(n), 8) AS ci_hi, true AS finite FROM m JOIN q95 ON nu = n - 1"""))
def _(spark, d):
    return rounded(S.mean_ci(_con_k(spark, d), ["k"], "dPdet").select("k", "n", "mean", "sd", "se", "ci_lo", "ci_hi", "finite"), 9, ci_lo=8, ci_hi=8)


@query("tost", with_(RUNS_K, CON_K, """
m AS (SELECT k, count(*) AS n, avg("dPdet") AS mean, stddev_samp("dPdet") / sqrt(count(*)) AS se FROM con GROUP BY k)""", t_quantile("q90", "m", 0.95), f"""
p AS (SELECT m.*, q, {t_sf('((mean + 0.01) / se)', '(n - 1)')} AS pl, {t_sf('(-(mean - 0.01) / se)', '(n - 1)')} AS pu FROM m JOIN q90 ON nu = n - 1)""", select="""SELECT k, n, round(mean, 9) AS mean, round(mean - q * se, 8) AS ci90_lo, round(mean + q * se, 8) AS ci90_hi,
    round(pl, 8) AS tost_p_lower, round(pu, 8) AS tost_p_upper, round(greatest(pl, pu), 8) AS tost_p_max, pl < 0.05 AND pu < 0.05 AS equivalent FROM p"""))
def _(spark, d):
    return rounded(S.tost(_con_k(spark, d), ["k"], "dPdet", 0.01).select("k", "n", "mean", "ci90_lo", "ci90_hi", "tost_p_lower", "tost_p_upper", "tost_p_max", "equivalent"), 8, mean=9)


@query("paired_summary", with_(RUNS_K, CON_K, """
m AS (SELECT k, count(*) AS n, avg("dL") AS mean, stddev_samp("dL") / sqrt(count(*)) AS se, count(*) FILTER ("dL" > 0) AS favorable_count, count(*) FILTER ("dL" >= 0) AS non_adverse_count FROM con GROUP BY k)""", f"""
p AS (SELECT m.*, {t_sf('((mean + 0.05) / se)', '(n - 1)')} AS pl, {t_sf('(-(mean - 0.05) / se)', '(n - 1)')} AS pu FROM m)""", select="SELECT k, n, n AS n_total, round(mean, 9) AS mean, favorable_count, non_adverse_count, pl < 0.05 AND pu < 0.05 AS equivalent FROM p"))
def _(spark, d):
    return rounded(S.paired_summary(_con_k(spark, d), ["k"], "dL", 0.05).select("k", "n", "n_total", "mean", "favorable_count", "non_adverse_count", "equivalent"))


@query("holm", with_(RUNS, CON, """
p AS (SELECT dataset, planning_seed, exp(-40 * abs("dPdet")) AS p FROM con),
h AS (SELECT *, (count(*) OVER (PARTITION BY dataset) - row_number() OVER o + 1) * p AS raw FROM p WINDOW o AS (PARTITION BY dataset ORDER BY p)),
a AS (SELECT *, least(1.0, max(raw) OVER (PARTITION BY dataset ORDER BY p ROWS UNBOUNDED PRECEDING)) AS ph FROM h)""", select="SELECT dataset, planning_seed, round(p, 9) AS p, round(ph, 9) AS p_holm, ph < 0.05 AS reject FROM a"))
def _(spark, d):
    p = _con(spark, d).select("dataset", "planning_seed", F.exp(-40 * F.abs("dPdet")).alias("p"))
    return rounded(S.holm(p, ["dataset"], "p"))


@query("cap_p", """SELECT l_orderkey, l_linenumber, round(greatest(exp(-l_quantity), 1e-16), 12) AS p, CASE WHEN exp(-l_quantity) <= 1e-16 THEN '< 1e-16' ELSE printf('%.2e', exp(-l_quantity)) END AS p_text FROM lineitem""")
def _(spark, d):
    p = F.exp(-F.col("l_quantity"))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.cap_p(p), 12).alias("p"), S.fmt_p(p).alias("p_text"))


@query("wilcoxon_paired", with_(RUNS_K, CON_K, SR_K, select="SELECT k, n, n_nonzero, round(wp, 4) AS w_plus, round(wm, 4) AS w_minus, round(w, 4) AS statistic, round(pz, 8) AS p FROM wz"))
def _(spark, d):
    w = S.wilcoxon_paired(_con_k(spark, d), ["k"], "dPdet", "normal")
    return rounded(w.select("k", "n", "n_nonzero", "w_plus", "w_minus", "statistic", "p"), 4, p=8)


# every assignment of signs of a dataset's few differences
@query("wilcoxon_exact", with_(RUNS, contrasts(), """
rk AS (SELECT dataset, d, rank() OVER (PARTITION BY dataset ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, abs(d)) - 1) / 2.0::DOUBLE AS r,
    row_number() OVER (PARTITION BY dataset ORDER BY abs(d)) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS m FROM (SELECT dataset, "dPdet" AS d FROM con WHERE "dPdet" <> 0)),
st AS (SELECT dataset, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM rk GROUP BY dataset),
sg AS (SELECT dataset, s, any_value(m) AS m, coalesce(sum(r) FILTER ((s >> i) & 1 = 1), 0) AS v FROM rk, range(0, (SELECT 1 << max(m) FROM rk)) q(s) WHERE s < 1 << m GROUP BY dataset, s),
pp AS (SELECT dataset, any_value(w) AS w, 2.0::DOUBLE * count(*) FILTER (v <= w) / pow(2, any_value(m)) AS p FROM sg JOIN st USING (dataset) GROUP BY dataset),
nn AS (SELECT dataset, count(*) AS n FROM con GROUP BY dataset)""", select="""SELECT dataset, n, round(w, 8) AS statistic, round(coalesce(least(1.0, greatest(1e-16, p)), 1.0), 8) AS p FROM nn LEFT JOIN pp USING (dataset)"""))
def _(spark, d):
    return rounded(S.wilcoxon_paired(_con(spark, d), ["dataset"], "dPdet", "exact").select("dataset", "n", "statistic", "p"), 8)


@query("rank_biserial", with_(RUNS_K, CON_K, SR_K, select=f"SELECT k, n, n_nonzero, round(rb, 8) AS rank_biserial, {LABEL.format('rb')} AS magnitude FROM wz"))
def _(spark, d):
    return rounded(S.rank_biserial(_con_k(spark, d), ["k"], "dPdet").select("k", "n", "n_nonzero", "rank_biserial", "magnitude"), 8)


FR = """
bl AS (SELECT k, dataset, planning_seed FROM runs GROUP BY ALL HAVING count(*) = 3),
fr0 AS (SELECT k, planning_mode, rank() OVER (PARTITION BY k, dataset, planning_seed ORDER BY "P_detect") + (count(*) OVER (PARTITION BY k, dataset, planning_seed, "P_detect") - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY k, dataset, planning_seed, "P_detect") AS c FROM runs JOIN bl USING (k, dataset, planning_seed)),
fr1 AS (SELECT k, planning_mode, sum(r) AS sr, count(*) AS n, sum(c * c - 1) AS t FROM fr0 GROUP BY ALL),
fr AS (SELECT k, max(n) AS n, (12.0 / (max(n) * 12) * sum(sr * sr) - 12 * max(n)) / (1 - sum(t) / (max(n) * 24.0)) AS chi2 FROM fr1 GROUP BY k)"""


@query("friedman", with_(RUNS_K, FR, select="SELECT k, n AS n_complete, round(chi2, 7) AS chi2, round(greatest(1e-16, exp(-chi2 / 2)), 9) AS p FROM fr"))
def _(spark, d):
    return rounded(S.friedman(A.runs(spark, d, True), ["k"], KEYS, "planning_mode", "P_detect", ARMS), 9, chi2=7)


def mwu_sql(by: str, src: str, arm: str, a: str, b: str, v: str) -> str:
    return f"""
mw0 AS (SELECT {by}, {arm} AS arm, rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {by}, {v}) AS c FROM {src} WHERE {arm} IN ('{a}', '{b}')),
mw1 AS (SELECT {by}, count(*) FILTER (arm = '{a}') AS n_a, count(*) FILTER (arm = '{b}') AS n_b, sum(r) FILTER (arm = '{a}') AS ra, sum(c * c - 1) AS tt FROM mw0 GROUP BY {by}),
mw2 AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS u, n_a + n_b AS nn FROM mw1),
mw3 AS (SELECT *, (greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * (nn + 1 - tt / (nn * (nn - 1.0)))) AS z, 2 * u / (n_a * n_b) - 1 AS cd FROM mw2),
mw AS (SELECT *, CASE WHEN z <= 0 THEN 1.0 ELSE {phi2('z')} END AS p FROM mw3)"""


MW = mwu_sql("o_orderpriority", "orders", "o_orderstatus", "F", "O", "o_totalprice")


@query("mann_whitney", with_(MW, select='SELECT o_orderpriority, n_a, n_b, round(u, 2) AS "U", round(p, 8) AS p FROM mw'))
def _(spark, d):
    r = S.mann_whitney(A.table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice")
    return rounded(r.select("o_orderpriority", "n_a", "n_b", F.col("U").cast("double").alias("U"), "p"), 2, p=8)


# rank sums of the smaller arm over all choices, one element after the other
@query("mann_whitney_exact", with_("""
el0 AS (SELECT s_nationkey AS g, s_acctbal AS v, s_suppkey % 8 = 0 AS a FROM supplier WHERE s_acctbal IS NOT NULL),
el AS (SELECT g, a, row_number() OVER (PARTITION BY g ORDER BY v) AS i, CAST(2 * rank() OVER (PARTITION BY g ORDER BY v) + count(*) OVER (PARTITION BY g, v) - 1 AS BIGINT) AS r FROM el0),
en AS (SELECT g, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, coalesce(sum(r) FILTER (a), 0) AS ra, coalesce(sum(r) FILTER (NOT a), 0) AS rb FROM el GROUP BY g),
dp(g, i, k, s, w) AS (SELECT g, 0, 0, 0, 1.0::DOUBLE FROM en
    UNION ALL SELECT g, i, k, s, sum(w) FROM (SELECT dp.g, CAST(dp.i + 1 AS INT) AS i, dp.k + d AS k, CAST(dp.s + d * r AS INT) AS s, w FROM dp JOIN el ON el.g = dp.g AND el.i = dp.i + 1 JOIN en ON en.g = dp.g, (VALUES (0), (1)) q(d) WHERE dp.k + d <= least(n_a, n_b)) GROUP BY ALL),
fin AS (SELECT dp.*, CASE WHEN n_a <= n_b THEN ra ELSE rb END AS obs FROM dp JOIN en USING (g) WHERE i = n_a + n_b AND k = least(n_a, n_b)),
pv AS (SELECT g, least(1.0, 2 * least(sum(w) FILTER (s <= obs), sum(w) FILTER (s >= obs)) / sum(w)) AS p FROM fin GROUP BY g)""",
                                    select='SELECT g AS s_nationkey, n_a, n_b, round(CAST(ra / 2.0 - n_a * (n_a + 1) / 2.0 AS DOUBLE), 2) AS "U", round(p, 9) AS p FROM en JOIN pv USING (g)').replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    s = A.table(spark, d, "supplier").withColumn("arm", F.when(F.col("s_suppkey") % 8 == 0, "a").otherwise("b"))
    return rounded(S.mann_whitney_exact(s, ["s_nationkey"], "arm", "a", "b", "s_acctbal"), 9, U=2)


@query("cliffs_delta", with_(MW, select=f"SELECT o_orderpriority, n_a, n_b, round(cd, 9) AS cliffs_delta, {LABEL.format('cd')} AS magnitude FROM mw"))
def _(spark, d):
    return rounded(S.cliffs_delta(A.table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice"))


KW = """
kw0 AS (SELECT c_mktsegment AS g, CASE c_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS arm, c_acctbal AS v FROM customer),
kw1 AS (SELECT g, arm, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY g, v) AS c FROM kw0),
kw2 AS (SELECT g, arm, sum(r) AS sr, count(*) AS m, sum(c * c - 1) AS t FROM kw1 GROUP BY ALL),
kw AS (SELECT g, count(*) AS "groups", sum(m) AS n, (12.0 / (sum(m) * (sum(m) + 1.0)) * sum(sr * sr / m) - 3 * (sum(m) + 1)) / (1 - sum(t) / (sum(m) * sum(m) * sum(m) * 1.0 - sum(m))) AS h FROM kw2 GROUP BY g)"""


def _kw(spark, d):
    arm = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("c_nationkey") % 3 + 1)
    return A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), arm.alias("arm"), F.col("c_acctbal").alias("v"))


@query("kruskal", with_(KW, select='SELECT g, "groups", CAST(n AS BIGINT) AS n, round(h, 7) AS "H", round(greatest(1e-16, exp(-h / 2)), 9) AS p FROM kw'))
def _(spark, d):
    return rounded(S.kruskal(_kw(spark, d), ["g"], "arm", "v"), 9, H=7)


@query("cohens_d", """WITH c AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_a, count(*) FILTER (o_orderstatus = 'O') AS n_b, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS b,
    var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS va, var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS vb FROM orders GROUP BY 1),
    d AS (SELECT *, (a - b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS cd FROM c)
    SELECT o_orderpriority, n_a, n_b, round(a, 4) AS mean_a, round(b, 4) AS mean_b, round(cd, 9) AS cohens_d, CASE WHEN abs(cd) < 0.2 THEN 'negligible' WHEN abs(cd) < 0.5 THEN 'small' WHEN abs(cd) < 0.8 THEN 'medium' ELSE 'large' END AS d_magnitude FROM d""")
def _(spark, d):
    return rounded(S.cohens_d(A.table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice"), 9, mean_a=4, mean_b=4)


@query("levene", with_("""
z0 AS (SELECT c_mktsegment AS g, CASE c_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS arm, c_acctbal AS v FROM customer),
z1 AS (SELECT g, arm, abs(v - median(v) OVER (PARTITION BY g, arm)) AS z FROM z0),
z2 AS (SELECT g, arm, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM z1 GROUP BY ALL),
z3 AS (SELECT g, sum(n) AS n, count(*) AS k, (sum(n) - count(*)) / (count(*) - 1) * (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / sum(ss) AS w FROM z2 GROUP BY g)""",
                      select='SELECT g, CAST(n AS BIGINT) AS n, k AS "groups", round(w, 7) AS "W", round(pow(1 + 2 * w / (n - 3), -(n - 3) / 2.0), 8) AS p FROM z3'))
def _(spark, d):
    return rounded(S.levene(_kw(spark, d), ["g"], "arm", "v"), 7, p=8)


@query("normality_jb", """WITH a AS (SELECT o_orderpriority, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS c FROM orders),
    m AS (SELECT o_orderpriority, count(*) AS n, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM a GROUP BY 1),
    s AS (SELECT o_orderpriority, n, m3 / pow(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM m)
    SELECT o_orderpriority, n, round(sk, 7) AS skewness, round(ku, 7) AS kurtosis, round(n / 6.0 * (sk * sk + ku * ku / 4), 4) AS jb, round(greatest(1e-16, exp(-(n / 6.0 * (sk * sk + ku * ku / 4)) / 2)), 9) AS p FROM s""")
def _(spark, d):
    return rounded(S.normality_jb(A.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), 7, jb=4, p=9)


def u52(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 13))::BIGINT / 4503599627370496.0"


def poisson(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {c!r})::INT" for c in accumulate(1 / math.factorial(i) / math.e for i in range(19))) + ")"


@query("bootstrap_mean_ci", with_(RUNS, f"""
x AS (SELECT planning_mode, "P_detect" AS v, b, {u52("'5'", 'b', 'dataset', 'planning_seed', 'planning_mode')} AS u FROM runs, range(0, 200) r(b)),
y AS (SELECT planning_mode, b, v, {poisson('u')} AS w FROM x),
rep AS (SELECT planning_mode, b, sum(w * v) / sum(w) AS m FROM y GROUP BY ALL)""", select="""SELECT planning_mode, round(avg("P_detect"), 9) AS mean, count(*) AS n, round(any_value(lo), 9) AS ci_lo, round(any_value(hi), 9) AS ci_hi
    FROM runs JOIN (SELECT planning_mode, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM rep GROUP BY 1) USING (planning_mode) GROUP BY 1"""))
def _(spark, d):
    return rounded(S.bootstrap_mean_ci(_runs(spark, d), ["planning_mode"], "P_detect", ["dataset", "planning_seed", "planning_mode"], 200, 5))


@query("cluster_bootstrap", with_(RUNS_K, CON_K, """
c AS (SELECT k, dataset, avg("dPdet") AS m, row_number() OVER (PARTITION BY k ORDER BY dataset) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM con GROUP BY k, dataset),
s AS (SELECT k, b, CAST(floor((""" + u52("'9'", "b", "i") + """) * n) AS BIGINT) AS i FROM c, range(0, 500) r(b)),
rep AS (SELECT k, b, avg(m) AS r FROM s JOIN c USING (k, i) GROUP BY ALL)""", select="""SELECT k, any_value(nc) AS n_clusters, round(any_value(mean), 9) AS mean, round(quantile_cont(r, 0.025), 9) AS ci_lo, round(quantile_cont(r, 0.975), 9) AS ci_hi
    FROM rep JOIN (SELECT k, count(*) AS nc, avg(m) AS mean FROM c GROUP BY k) USING (k) GROUP BY k"""))
def _(spark, d):
    return rounded(S.cluster_bootstrap(_con_k(spark, d), ["k"], "dataset", "dPdet", 500, 9))


GS = "".join(f"""{sep}
g{e} AS (SELECT dataset, avg("{v}") AS m, row_number() OVER (ORDER BY dataset) - 1 AS i, count(*) OVER () AS n FROM con GROUP BY dataset),
p{e} AS (SELECT b, CAST(floor(({u52("'20260826'", "b", "i")}) * n) AS BIGINT) AS i FROM g{e}, range(0, 1000) r(b)),
r{e} AS (SELECT b, avg(m) AS r FROM p{e} JOIN g{e} USING (i) GROUP BY b),
f{e} AS (SELECT '{v}' AS endpoint, {margin} AS margin, count(*) AS n_clusters, avg(m) AS mean, stddev_samp(m) AS sd, stddev_samp(m) / sqrt(count(*)) AS se, CAST(count(*) - 1 AS BIGINT) AS nu FROM g{e}),
h{e} AS (SELECT f.*, {t_sf(f'((mean + {margin}) / se)', 'nu')} < 0.05 AND {t_sf(f'(-(mean - {margin}) / se)', 'nu')} < 0.05 AS equivalent,
    (SELECT quantile_cont(r, 0.025) FROM r{e}) AS ci_lo, (SELECT quantile_cont(r, 0.975) FROM r{e}) AS ci_hi FROM f{e} f)""" for sep, e, v, margin in (("", 1, "dPdet", 0.01), (",", 2, "dRMST_rel", 0.02)))
GS_ROW = """SELECT n_clusters, round(mean, 9) AS mean, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi, round(sd, 9) AS sd, equivalent, endpoint, CAST(round(margin, 9) AS DOUBLE) AS margin,
    CASE WHEN mean >= margin AND ci_lo > 0 THEN 'IMPROVED' WHEN mean <= -margin AND ci_hi < 0 THEN 'WORSENED' WHEN equivalent THEN 'EQUIVALENT' ELSE 'INCONCLUSIVE' END AS classification FROM """


@query("global_summary", with_(RUNS, contrasts(), GS, select=f"{GS_ROW} h1 UNION ALL {GS_ROW} h2"))
def _(spark, d):
    c = _con(spark, d)
    return rounded(M.global_summary(c, "dPdet", "dataset", "dPdet", 0.01, 1000, 20260826).unionByName(M.global_summary(c, "dRMST_rel", "dataset", "dRMST_rel", 0.02, 1000, 20260826)))


HB = """
b0 AS (SELECT CAST(s_nationkey AS INT) AS dataset, CAST(l_suppkey AS INT) AS planning_seed, (l_returnflag = 'R')::INT AS f1, (l_linestatus = 'O')::INT AS f2, avg(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
e AS (SELECT * FROM (SELECT dataset, planning_seed, (max(v) FILTER (f1 = 1 AND f2 = 1) - max(v) FILTER (f1 = 0 AND f2 = 1)) - (max(v) FILTER (f1 = 1 AND f2 = 0) - max(v) FILTER (f1 = 0 AND f2 = 0)) AS x FROM b0 GROUP BY ALL) WHERE x IS NOT NULL),
cl AS (SELECT dataset, count(*) AS nu, row_number() OVER (ORDER BY dataset) - 1 AS ci, count(*) OVER () AS nc FROM e GROUP BY dataset),
un AS (SELECT ci, row_number() OVER (PARTITION BY dataset ORDER BY planning_seed) - 1 AS ui, x FROM e JOIN cl USING (dataset)),
dr AS (SELECT b, ci AS slot, CAST(floor((""" + u52("'3'", "b", "ci") + """) * nc) AS BIGINT) AS pick FROM cl, range(0, 100) r(b)),
sd AS (SELECT b, slot, pick, nu, unnest(range(0, nu)) AS j FROM dr JOIN cl ON cl.ci = pick),
pk AS (SELECT b, slot, pick AS ci, CAST(floor((""" + u52("'3'", "b", "slot", "j") + """) * nu) AS BIGINT) AS ui FROM sd),
rep AS (SELECT b, avg(m) AS r FROM (SELECT b, slot, avg(x) AS m FROM pk JOIN un USING (ci, ui) GROUP BY ALL) GROUP BY b)"""


@query("hierarchical_bootstrap", with_(HB, select="""SELECT round((SELECT avg(x) FROM e), 8) AS interaction_mean, round(quantile_cont(r, 0.025), 8) AS ci_lower, round(quantile_cont(r, 0.975), 8) AS ci_upper, (SELECT count(*) FROM cl) AS n_clusters, (SELECT count(*) FROM e) AS n_cells FROM rep"""))
def _(spark, d):
    i = P.factorial_contrasts(four_arms(spark, d), KEYS, "L", "static", "static_3step", "dynamic", "dynamic_3step").where("I IS NOT NULL").select(*KEYS, "I")
    return rounded(S.hierarchical_bootstrap(i, "dataset", "planning_seed", "I", 100, 3), 8)


CB = """
cx AS (SELECT planning_mode, "P_detect" AS v, b, """ + u52("'4'", "b", "dataset", "planning_seed", "planning_mode") + """ AS u FROM runs, range(0, 40) r(b) WHERE planning_mode IN ('A', 'R')),
cy AS (SELECT 1 AS g, planning_mode, b, v, """ + poisson("u") + """ AS w FROM cx),
cz AS (SELECT x.b, sum(x.w * y.w * sign(x.v - y.v)) / (sum(x.w * y.w) * 1.0) AS d FROM cy x JOIN cy y ON x.b = y.b AND x.planning_mode = 'A' AND y.planning_mode = 'R' WHERE x.w > 0 AND y.w > 0 GROUP BY x.b),
c0 AS (SELECT sum(sign(x."P_detect" - y."P_detect")) / count(*) AS cd, CAST(sqrt(count(*)) AS BIGINT) AS n FROM runs x, runs y WHERE x.planning_mode = 'A' AND y.planning_mode = 'R')"""
CBS = f"""SELECT n AS n_a, n AS n_b, round(cd, 8) AS cliffs_delta, {LABEL.format('cd')} AS magnitude, round(se, 8) AS se, round(lo, 8) AS ci_lo, round(hi, 8) AS ci_hi{{0}}
    FROM c0, (SELECT stddev_samp(d) AS se, quantile_cont(d, {{1}}) AS lo, quantile_cont(d, {{2}}) AS hi FROM cz)"""


@query("cliffs_delta_ci", with_(RUNS, CB, select=CBS.format("", 0.025, 0.975)))
def _(spark, d):
    r = _runs(spark, d)
    return rounded(S.cliffs_delta_ci(r, [], "planning_mode", "A", "R", "P_detect", ["dataset", "planning_seed"], 40, 4), 8)


@query("cliff_equivalence", with_(RUNS, CB, select=CBS.format(", lo > -0.147 AND hi < 0.147 AS equivalent", 0.05, 0.95)))
def _(spark, d):
    ci = S.cliffs_delta_ci(_runs(spark, d), [], "planning_mode", "A", "R", "P_detect", ["dataset", "planning_seed"], 40, 4, confidence=0.9)
    return rounded(S.cliff_equivalence(ci), 8)


PW = """
pr AS (SELECT a.dataset, a.planning_seed, a.planning_mode AS f, b.planning_mode AS s, a."P_detect" AS va, b."P_detect" AS vb, a."P_detect" - b."P_detect" AS d FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.planning_seed = b.planning_seed AND a.planning_mode < b.planning_mode)"""


@query("pairwise_table", with_(RUNS, PW, signed_ranks("pr", "f, s", "d"), """
pm AS (SELECT f, s, avg(va) AS ma, avg(vb) AS mb, (avg(va) - avg(vb)) / sqrt((var_samp(va) + var_samp(vb)) / 2) AS cd FROM pr GROUP BY ALL),
pj AS (SELECT *, (3 - row_number() OVER (ORDER BY pz) + 1) * pz AS raw FROM pm JOIN wz USING (f, s)),
ph AS (SELECT *, least(1.0, max(raw) OVER (ORDER BY pz ROWS UNBOUNDED PRECEDING)) AS h FROM pj)""", select=f"""SELECT f AS "first", s AS "second", round(ma, 9) AS mean_a, round(mb, 9) AS mean_b, round(cd, 8) AS cohens_d, n, round(w, 4) AS statistic, round(rb, 8) AS rank_biserial,
    {LABEL.format('rb')} AS magnitude, round(pz, 8) AS p, round(ma - mb, 9) AS delta_mean, round(100 * (ma - mb) / mb, 7) AS pct_rel, round(h, 8) AS p_holm, h < 0.05 AS reject FROM ph"""))
def _(spark, d):
    return rounded(M.pairwise_table(_runs(spark, d), [], KEYS, "planning_mode", ARMS, "P_detect"), 8, mean_a=9, mean_b=9, delta_mean=9, pct_rel=7, statistic=4)


@query("study_report", with_(RUNS, PW.replace("a.planning_mode < b.planning_mode", "b.planning_mode = 'A' AND a.planning_mode <> 'A'"), signed_ranks("pr", "f", "d"), """
hj AS (SELECT *, (2 - row_number() OVER (ORDER BY pz) + 1) * pz AS raw FROM wz), hh AS (SELECT *, least(1.0, max(raw) OVER (ORDER BY pz ROWS UNBOUNDED PRECEDING)) AS h FROM hj)""",
                            FR.replace("k, dataset", "dataset").replace("(k, ", "(").replace("SELECT k, ", "SELECT ").replace("GROUP BY k)", ")").replace("PARTITION BY k, ", "PARTITION BY "),
                            select="""SELECT planning_mode, round(avg("P_detect"), 9) AS mean, round(stddev_samp("P_detect"), 9) AS std, count(*) AS n, round(stddev_samp("P_detect") / sqrt(count(*)), 9) AS se, round(quantile_cont("P_detect", 0.25), 9) AS q25, round(median("P_detect"), 9) AS median,
    round(quantile_cont("P_detect", 0.75), 9) AS q75, round(quantile_cont("P_detect", 0.75) - quantile_cont("P_detect", 0.25), 9) AS iqr, round(any_value(w), 4) AS statistic, round(any_value(rb), 8) AS effect, round(any_value(pz), 8) AS p, round(any_value(h), 8) AS p_holm, any_value(h < 0.05) AS reject,
    round((SELECT chi2 FROM fr), 7) AS omnibus, round((SELECT greatest(1e-16, exp(-chi2 / 2)) FROM fr), 9) AS omnibus_p FROM runs LEFT JOIN hh ON f = planning_mode GROUP BY planning_mode"""))
def _(spark, d):
    return rounded(M.study_report(_runs(spark, d), KEYS, "planning_mode", ARMS, "A", "P_detect"), 9, statistic=4, effect=8, p=8, p_holm=8, omnibus=7)


UNPAIRED = "".join(mwu_sql("one", "(SELECT 1 AS one, * FROM orders)", "o_orderstatus", a, "F", "o_totalprice").replace("mw", f"m{a}") + "," for a in "OP") + f"""
ut AS (SELECT *, row_number() OVER (ORDER BY p) AS nth FROM (SELECT 'O' AS arm, u, cd, greatest(1e-16, p) AS p FROM mO UNION ALL SELECT 'P', u, cd, greatest(1e-16, p) FROM mP)),
uh AS (SELECT *, least(1.0, max((3 - nth) * p) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)) AS h FROM ut),
uk0 AS (SELECT o_orderstatus AS arm, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY o_totalprice) AS c FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')),
uk1 AS (SELECT arm, sum(r) AS sr, count(*) AS m, sum(c * c - 1) AS t FROM uk0 GROUP BY arm),
uk AS (SELECT (12.0 / (sum(m) * (sum(m) + 1.0)) * sum(sr * sr / m) - 3 * (sum(m) + 1)) / (1 - sum(t) / (sum(m) * sum(m) * sum(m) * 1.0 - sum(m))) AS h FROM uk1)"""


@query("study_report_unpaired", with_(UNPAIRED, select="""SELECT o_orderstatus, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, count(*) AS n, round(stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS se, round(quantile_cont(o_totalprice, 0.25), 6) AS q25,
    round(median(o_totalprice), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr, round(any_value(u)::DOUBLE, 6) AS statistic, round(any_value(cd), 6) AS effect, round(any_value(p), 6) AS p, round(any_value(uh.h), 6) AS p_holm,
    any_value(uh.h < 0.05) AS reject, round((SELECT h FROM uk), 6) AS omnibus, round((SELECT greatest(1e-16, exp(-h / 2)) FROM uk), 6) AS omnibus_p FROM orders LEFT JOIN uh ON arm = o_orderstatus WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_orderstatus"""))
def _(spark, d):
    return rounded(M.study_report(A.table(spark, d, "orders"), ["o_orderkey"], "o_orderstatus", ["F", "O", "P"], "F", "o_totalprice", paired=False), 6)


@query("wins_by_cluster", with_(RUNS, PW.replace("a.planning_mode < b.planning_mode", "a.planning_mode = 'R' AND b.planning_mode = 'A'"), signed_ranks("pr", "dataset", "d"), """
wc AS (SELECT dataset, avg(va) AS ma, avg(vb) AS mb FROM pr GROUP BY 1), we AS (SELECT *, CASE WHEN n_nonzero = 0 THEN 1.0 ELSE greatest(1e-16, pz) END AS pe FROM wz)""", select=f"""SELECT dataset, round(ma, 9) AS mean_a, round(mb, 9) AS mean_b, n AS n_pairs, round(rb, 8) AS rank_biserial, {LABEL.format('rb')} AS magnitude, round(w, 4) AS statistic, round(pe, 8) AS p,
    round(ma - mb, 9) AS delta_mean, round(100 * (ma - mb) / mb, 7) AS pct_rel, (CASE WHEN ma - mb > 0 THEN 'R' ELSE 'A' END) || (CASE WHEN pe < 0.05 THEN '*' ELSE '' END) AS winner FROM wc JOIN we USING (dataset)"""))
def _(spark, d):
    return rounded(M.wins_by_cluster(_runs(spark, d), ["dataset"], ["planning_seed"], "planning_mode", "R", "A", "P_detect"), 9, rank_biserial=8, statistic=4, p=8, pct_rel=7)


SAT = """
sat AS (SELECT p_size, o_orderstatus, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


@query("saturation_curve", with_(SAT, mwu_sql("p_size", "sat", "o_orderstatus", "F", "O", "v"), """
sc AS (SELECT p_size, avg(v) FILTER (o_orderstatus = 'F') AS a, avg(v) FILTER (o_orderstatus = 'O') AS b, var_samp(v) FILTER (o_orderstatus = 'F') AS va, var_samp(v) FILTER (o_orderstatus = 'O') AS vb FROM sat GROUP BY 1),
sd AS (SELECT *, (a - b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS cdx FROM sc JOIN mw USING (p_size))""", select="""SELECT p_size, n_a, n_b, round(a, 4) AS mean_a, round(b, 4) AS mean_b, round(cdx, 8) AS cohens_d,
    CASE WHEN abs(cdx) < 0.2 THEN 'negligible' WHEN abs(cdx) < 0.5 THEN 'small' WHEN abs(cdx) < 0.8 THEN 'medium' ELSE 'large' END AS d_magnitude, round(u, 2) AS "U", round(p, 8) AS p, round(a - b, 4) AS delta_mean, CASE WHEN p < 0.05 THEN (CASE WHEN a > b THEN 'F' ELSE 'O' END) ELSE 'tie' END AS winner FROM sd"""))
def _(spark, d):
    li, pa, o = (A.table(spark, d, t) for t in ("lineitem", "part", "orders"))
    s = li.join(pa, li.l_partkey == pa.p_partkey).join(o, li.l_orderkey == o.o_orderkey).select("p_size", "o_orderstatus", F.col("l_extendedprice").alias("v"))
    r = M.saturation_curve(s, "p_size", "o_orderstatus", "F", "O", "v").withColumn("U", F.col("U").cast("double"))
    return rounded(r, 4, cohens_d=8, p=8, U=2)


# the shifted t distribution as a normal one averaged over the spread of its root mean square s: 401 equal steps around 1
POWER = f"""
ef AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_a, count(*) FILTER (o_orderstatus = 'O') AS n_b, (avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O'))
    / sqrt(((count(*) FILTER (o_orderstatus = 'F') - 1) * var_samp(o_totalprice) FILTER (o_orderstatus = 'F') + (count(*) FILTER (o_orderstatus = 'O') - 1) * var_samp(o_totalprice) FILTER (o_orderstatus = 'O'))
    / (count(*) FILTER (o_orderstatus IN ('F', 'O')) - 2)) AS cd, count(*) FILTER (o_orderstatus IN ('F', 'O')) - 1 AS n FROM orders GROUP BY 1),{t_quantile('eq', 'ef', 0.975)},
eg AS (SELECT *, sqrt(n_a * n_b / CAST(n_a + n_b AS DOUBLE)) AS scale FROM ef JOIN eq ON nu = n - 1),
es0 AS (SELECT o_orderpriority, q, scale, nu, greatest(1e-9, 1 + (i - 200) / 200.0 * 9 / sqrt(2.0 * nu)) AS s FROM eg, range(0, 401) r(i)),
es AS (SELECT o_orderpriority, q * s AS qs, scale, exp((nu - 1) * ln(s) - nu * (s * s - 1) / 2) AS w FROM es0)"""


def normal_cdf(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 1 - {phi2(x)} / 2 ELSE {phi2(x)} / 2 END)"


def power_of(d: str) -> str:
    up, down = normal_cdf(f"(qs - {d} * scale)"), normal_cdf(f"(-qs - {d} * scale)")
    return f"sum(w * (1 - {up} + {down})) / sum(w)"


@query("achieved_power", with_(POWER, f"""
ep AS (SELECT o_orderpriority, {power_of('abs(cd)')} AS power FROM (SELECT es.*, cd FROM es JOIN ef USING (o_orderpriority)) GROUP BY o_orderpriority)""",
                                select="SELECT o_orderpriority, n_a, n_b, round(cd, 8) AS cohens_d, round(power, 8) AS power FROM ef JOIN ep USING (o_orderpriority)"))
def _(spark, d):
    e = S.cohens_d(A.table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice")
    return rounded(S.achieved_power(e).select("o_orderpriority", "n_a", "n_b", "cohens_d", "power"), 8)


@query("min_detectable", with_(POWER, f"""
bi(o_orderpriority, step, lo, hi) AS (SELECT o_orderpriority, 0, 0.0::DOUBLE, 10.0::DOUBLE FROM ef
    UNION ALL SELECT o_orderpriority, step + 1, CASE WHEN p < 0.8 THEN mid ELSE lo END, CASE WHEN p < 0.8 THEN hi ELSE mid END FROM (
        SELECT o_orderpriority, step, lo, hi, mid, {power_of('mid')} AS p FROM (SELECT bi.*, (lo + hi) / 2 AS mid FROM bi WHERE step < 60) JOIN es USING (o_orderpriority) GROUP BY ALL))""",
                               select="SELECT o_orderpriority, n_a, n_b, round((lo + hi) / 2, 8) AS min_detectable_d FROM ef JOIN bi USING (o_orderpriority) WHERE step = 60").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    e = S.cohens_d(A.table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "F", "O", "o_totalprice").select("o_orderpriority", "n_a", "n_b")
    return rounded(S.min_detectable(e), 8)


def _lmm(spark, d):
    r = _runs(spark, d)
    return S.mixed_model(r, "dataset", "P_detect", {"armN": (F.col("planning_mode") == "N").cast("int"), "armR": (F.col("planning_mode") == "R").cast("int")})


# likelihood of a ratio from sums per cluster; five grids of 33 ratios, each around the best of the one before
LMM_ROUNDS = 5
LMM_SUMS = """
cs AS (SELECT dataset, count(*)::DOUBLE AS n, sum("P_detect") AS sy, sum("P_detect" * "P_detect") AS yy, sum((planning_mode = 'N')::INT)::DOUBLE AS s1, sum((planning_mode = 'R')::INT)::DOUBLE AS s2,
    coalesce(sum("P_detect") FILTER (planning_mode = 'N'), 0) AS y1, coalesce(sum("P_detect") FILTER (planning_mode = 'R'), 0) AS y2 FROM runs GROUP BY dataset)"""


def lmm_at(name: str, ratios: str) -> str:
    return f"""
{name}w AS (SELECT ratio, lo, hi, cs.*, ratio / (1 + n * ratio) AS w FROM cs, ({ratios})),
{name}s AS (SELECT ratio, lo, hi, sum(n - w * n * n) AS a00, sum(s1 - w * n * s1) AS a01, sum(s2 - w * n * s2) AS a02, sum(s1 - w * s1 * s1) AS a11, sum(-w * s1 * s2) AS a12, sum(s2 - w * s2 * s2) AS a22,
    sum(sy - w * n * sy) AS b0, sum(y1 - w * s1 * sy) AS b1, sum(y2 - w * s2 * sy) AS b2, sum(yy - w * sy * sy) AS c, sum(ln(1 + n * ratio)) AS ld, sum(n) AS n, count(*) AS k FROM {name}w GROUP BY ratio, lo, hi),
{name}d AS (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det FROM {name}s),
{name}b AS (SELECT *, (b0 * (a11 * a22 - a12 * a12) + b1 * (a02 * a12 - a01 * a22) + b2 * (a01 * a12 - a02 * a11)) / det AS e0, (b0 * (a12 * a02 - a01 * a22) + b1 * (a00 * a22 - a02 * a02) + b2 * (a01 * a02 - a00 * a12)) / det AS e1,
    (b0 * (a01 * a12 - a11 * a02) + b1 * (a01 * a02 - a00 * a12) + b2 * (a00 * a11 - a01 * a01)) / det AS e2 FROM {name}d),
{name}v AS (SELECT *, (c - b0 * e0 - b1 * e1 - b2 * e2) / (n - 3) AS s2 FROM {name}b),
{name} AS (SELECT *, -0.5 * ((n - 3) * (ln(2 * pi() * s2) + 1) + ld + ln(det)) AS ll FROM {name}v ORDER BY ll DESC LIMIT 1)"""


LMM = LMM_SUMS + "," + lmm_at("l0", "SELECT exp(lo + (hi - lo) * i / 32) AS ratio, lo, hi FROM (SELECT ln(1e-6) AS lo, ln(1e4) AS hi), range(0, 33) r(i)") + "".join(
    "," + lmm_at(f"l{j}", f"SELECT exp(lo + (hi - lo) * i / 32) AS ratio, lo, hi FROM (SELECT ln(ratio) - (hi - lo) / 32 AS lo, ln(ratio) + (hi - lo) / 32 AS hi FROM l{j - 1}), range(0, 33) r(i)") for j in range(1, LMM_ROUNDS)
) + "," + lmm_at("lz", "SELECT 0.0::DOUBLE AS ratio, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi") + f"""
, lf AS (SELECT x.*, 2 * greatest(0.0, x.ll - z.ll) AS lrt FROM l{LMM_ROUNDS - 1} x, lz z)"""


@query("mixed_model", with_(RUNS, LMM, select=f"""SELECT round(e0, 6) AS "Intercept", round(e1, 6) AS "armN", round(e2, 6) AS "armR", round(s2, 6) AS sigma2, round(ratio * s2, 6) AS tau2, round(ratio / (1 + ratio), 6) AS icc, round(ll, 6) AS llf,
    round(lrt, 6) AS lrt, round(ratio, 6) AS ratio, CAST(n AS BIGINT) AS n, k AS n_clusters, round(greatest(1e-16, {phi2('sqrt(lrt)')} / 2), 6) AS lrt_p FROM lf"""))
def _(spark, d):
    return rounded(_lmm(spark, d), 6)


@query("cluster_effects", with_(RUNS, LMM, select="SELECT dataset, CAST(cs.n AS BIGINT) AS n, round(ratio / (1 + cs.n * ratio) * (sy - cs.n * e0 - s1 * e1 - cs.s2 * e2), 6) AS blup FROM cs, (SELECT ratio, e0, e1, e2 FROM lf)"))
def _(spark, d):
    x = {"armN": (F.col("planning_mode") == "N").cast("int"), "armR": (F.col("planning_mode") == "R").cast("int")}
    return rounded(S.cluster_effects(_runs(spark, d), "dataset", "P_detect", x, _lmm(spark, d)), 6)
