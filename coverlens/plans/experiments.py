"""Queries over the run tables: validation, pairing, contrasts, summaries, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.operators import classify as K
from coverlens.operators import pairing as P
from coverlens.operators import summaries as M
from coverlens.operators import validate as V
from coverlens.operators.stats import moments
from coverlens.plans.ctes import contrasts, runs, summary, t_quantile, t_sf, with_
from coverlens.plans.registry import query, rounded
from coverlens.sources import adapters as A

KEYS = ["dataset", "planning_seed"]
ARMS = ["A", "N", "R"]
RUNS, RUNS_K = runs(), runs(True)
CON, CON_K = contrasts(), contrasts("con", "runs", "dataset, planning_seed, k")
R9 = "round({0}, 9) AS {0}"


def _runs(spark, d):
    return A.runs(spark, d)


def _con(spark, d):
    return P.paired_contrasts(_runs(spark, d), KEYS, "A", "R")


def _con_k(spark, d):
    r = A.runs(spark, d, True)
    both = P.arm_pairs(r, KEYS + ["k"], "planning_mode", [("A", "R")], ["P_detect", "RMST", "L", "H_common"])
    return both.select(*KEYS, "k", (F.col("b_P_detect") - F.col("a_P_detect")).alias("dPdet"), ((F.col("a_RMST") - F.col("b_RMST")) / F.greatest("a_H_common", "b_H_common")).alias("dRMST_rel"),
                       (F.col("b_L") - F.col("a_L")).alias("dL"))


# ---- validation -----------------------------------------------------------------------------------------------------

VP = """
vc AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
vp AS (SELECT l_orderkey, l_linenumber, max(n) > 1 AS duplicate, NOT (count(*) = 3 AND count(*) FILTER (n = 1) = 3) AS incomplete, count(*) AS arms FROM vc GROUP BY ALL)"""


def _vp(spark, d):
    return V.validate_pairs(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag", ARMS)


@query("validate_pairs", with_(VP, select="SELECT * FROM vp"))
def _(spark, d):
    return _vp(spark, d)


@query("pair_status", with_(VP, select="""SELECT count(*) AS n_cells, count(*) FILTER (duplicate) AS duplicate_cells, count(*) FILTER (incomplete) AS incomplete_cells,
    count(*) FILTER (duplicate OR incomplete) = 0 AS valid FROM vp"""))
def _(spark, d):
    return V.pair_status(_vp(spark, d))


@query("validate_runs", with_(RUNS, select="""SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS non_finite, count(*) FILTER ("P_detect" < 0 OR "P_detect" > 1) + count(*) FILTER ("L" < 0 OR "L" > 1) AS out_of_range,
    CAST(0 AS INT) AS missing_columns, count(*) FILTER ("P_detect" < 0 OR "P_detect" > 1 OR "L" < 0 OR "L" > 1) = 0 AS valid FROM runs"""))
def _(spark, d):
    return V.validate_runs(_runs(spark, d), ["dataset", "planning_seed", "planning_mode", "P_detect", "RMST", "L"], ["P_detect", "RMST", "L", "T_common", "H_common"], ["P_detect", "L"])


@query("profile_runs", """SELECT count(*) AS "rows", count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_linenumber) AS n_l_linenumber, count(DISTINCT l_returnflag) AS n_l_returnflag,
    count(*) - count(DISTINCT (l_suppkey, l_linenumber, l_returnflag)) AS duplicates, CAST(0 AS BIGINT) AS missing_values, min(l_discount) AS value_min, max(l_discount) AS value_max FROM lineitem""")
def _(spark, d):
    return V.profile_runs(A.table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber", "l_returnflag"], "l_discount")


@query("fairness_checks", with_(RUNS, select="""SELECT dataset, planning_seed, count(DISTINCT initial_positions_hash) = 1 AS initial_positions_hash_equal, count(DISTINCT "H_common") = 1 AS "H_common_equal", count(DISTINCT "T") = 1 AS "T_equal",
    round(max(max_step_distance), 2) AS max_step, bool_and(max_step_distance <= 99000 + 1e-6) AS step_bound_ok, bool_or("T" < 50 AND revisit_fraction > 0.9) AS invalid_path_exhaustion FROM runs GROUP BY ALL"""))
def _(spark, d):
    return rounded(V.fairness_checks(_runs(spark, d), KEYS, ["initial_positions_hash", "H_common", "T"], 99000.0, exhausted=(F.col("T") < 50) & (F.col("revisit_fraction") > 0.9)), 2)


@query("branch_fairness", with_(RUNS_K, select="""SELECT dataset, planning_seed, planning_mode, count(DISTINCT initial_positions_hash) = 1 AS initial_positions_hash_equal, count(DISTINCT "T") = 1 AS "T_equal", count(DISTINCT "T_common") = 1 AS "T_common_equal" FROM runs GROUP BY ALL"""))
def _(spark, d):
    return V.fairness_checks(A.runs(spark, d, True), KEYS + ["planning_mode"], ["initial_positions_hash", "T", "T_common"])


@query("fairness_vs_baseline", with_(RUNS_K, select="""SELECT r.planning_mode, count(*) AS "rows", count(*) FILTER (b.dataset IS NULL) AS missing_baseline, count(*) FILTER (b.dataset IS NOT NULL AND NOT (r.initial_positions_hash = b.initial_positions_hash AND r."T" = b."T")) AS violations
    FROM runs r LEFT JOIN (SELECT * FROM runs WHERE planning_mode = 'A') b ON r.dataset = b.dataset AND r.planning_seed = b.planning_seed AND r.k = b.k WHERE r.planning_mode <> 'A' GROUP BY r.planning_mode"""))
def _(spark, d):
    return V.fairness_vs_baseline(A.runs(spark, d, True), KEYS + ["k"], "planning_mode", "A", ["initial_positions_hash", "T"])


@query("row_constraints", """SELECT c AS "constraint", v AS violations, v = 0 AS holds FROM (SELECT unnest(['discount_in_range', 'step_bound', 'exposure_positive', 'tax_below_discount']) AS c,
    unnest([count(*) FILTER (NOT (l_discount BETWEEN 0 AND 1)), count(*) FILTER (NOT l_extendedprice <= 95000), count(*) FILTER (NOT l_quantity >= 1), count(*) FILTER (NOT l_tax <= l_discount)]) AS v FROM lineitem)""")
def _(spark, d):
    c = F.col
    return V.row_constraints(A.table(spark, d, "lineitem"), {
        "discount_in_range": c("l_discount").between(0, 1), "step_bound": c("l_extendedprice") <= 95000, "exposure_positive": c("l_quantity") >= 1, "tax_below_discount": c("l_tax") <= c("l_discount")})


@query("exposure_semantics", with_(RUNS, select="""SELECT c AS "constraint", v AS violations, v = 0 AS holds FROM (SELECT unnest(['events_positive', 'P_in_range', 'L_in_range', 'multiplicity_at_least_one']) AS c,
    unnest([count(*) FILTER (NOT number_of_replans > 0), count(*) FILTER (NOT "P_detect" BETWEEN 0 AND 1), count(*) FILTER (NOT "L" BETWEEN 0 AND 1), count(*) FILTER (NOT exposure_multiplicity >= 1)]) AS v FROM runs)"""))
def _(spark, d):
    c = F.col
    return V.row_constraints(_runs(spark, d), {"events_positive": c("number_of_replans") > 0, "P_in_range": c("P_detect").between(0, 1), "L_in_range": c("L").between(0, 1), "multiplicity_at_least_one": c("exposure_multiplicity") >= 1})


@query("group_constraints", with_(RUNS_K, select="""SELECT count(*) AS "groups", count(*) FILTER (n <> 3) AS bad_size, count(*) FILTER (h <> 1) AS bad_initial_positions_hash, count(*) FILTER (t <> 1) AS "bad_T"
    FROM (SELECT dataset, planning_seed, k, count(*) AS n, count(DISTINCT initial_positions_hash) AS h, count(DISTINCT "T") AS t FROM runs GROUP BY ALL)"""))
def _(spark, d):
    return V.group_constraints(A.runs(spark, d, True), KEYS + ["k"], 3, ["initial_positions_hash", "T"])


AUD = """
oa AS (SELECT l_orderkey AS k, count(*) AS nl, min(l_extendedprice) AS a FROM lineitem GROUP BY 1),
ob AS (SELECT o_orderkey AS k, count(*) AS nr, min(o_totalprice) AS b FROM orders GROUP BY 1)"""


@query("consistency_audit", with_(AUD, select="""SELECT count(*) FILTER (nl IS NULL) AS missing_left, count(*) FILTER (nr IS NULL) AS missing_right, count(*) FILTER (coalesce(nl, 0) > 1 OR coalesce(nr, 0) > 1) AS duplicate_keys,
    count(*) FILTER (nl IS NOT NULL AND nr IS NOT NULL) AS matched, count(*) FILTER (nl IS NOT NULL AND nr IS NOT NULL AND abs(a - b) > 1000) AS mismatches, round(max(abs(a - b)), 2) AS max_abs_diff FROM oa FULL JOIN ob USING (k)"""))
def _(spark, d):
    l = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"))
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return rounded(V.consistency_audit(l, o, ["k"], ["v"], 1000.0), 2)


@query("recompute_check", with_(RUNS, """
st AS (SELECT dataset, planning_seed, planning_mode, round("P_detect", 3) AS p FROM runs)""", select="""SELECT CAST(0 AS BIGINT) AS missing_left, CAST(0 AS BIGINT) AS missing_right, CAST(0 AS BIGINT) AS duplicate_keys, count(*) AS matched,
    count(*) FILTER (abs("P_detect" - p) > 1e-4) AS mismatches, round(max(abs("P_detect" - p)), 9) AS max_abs_diff FROM runs JOIN st USING (dataset, planning_seed, planning_mode)"""))
def _(spark, d):
    r = _runs(spark, d)
    k = KEYS + ["planning_mode"]
    stored = r.select(*k, F.round("P_detect", 3).alias("P_detect"))
    return rounded(V.consistency_audit(r.select(*k, "P_detect"), stored, k, ["P_detect"], 1e-4))


@query("row_count_contract", with_(RUNS, select="""SELECT dataset, coalesce(n, 0) AS "rows", coalesce(e, 0) AS expected_rows, coalesce(n, 0) = coalesce(e, 0) AS matches
    FROM (SELECT dataset, count(*) AS n FROM runs GROUP BY 1) FULL JOIN (SELECT CAST(s_nationkey AS INT) AS dataset, count(*) * 3 AS e FROM supplier GROUP BY 1) USING (dataset)"""))
def _(spark, d):
    c = A.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("dataset")).agg((F.count("*") * 3).alias("expected_rows"))
    return V.row_count_contract(_runs(spark, d), c, "dataset")


@query("manifest_diff", with_("""
a AS (SELECT doc_id AS path, sha256(text) AS s FROM documents), m AS (SELECT doc_id AS path, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(text || ' ') END AS s FROM labels JOIN documents USING (doc_id))""",
                               select="""SELECT path, CASE WHEN a.s IS NULL THEN 'missing' WHEN m.s IS NULL THEN 'extra' ELSE 'changed' END AS status FROM a FULL JOIN m USING (path) WHERE a.s IS NULL OR m.s IS NULL OR a.s <> m.s"""))
def _(spark, d):
    doc = A.table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    lab = A.table(spark, d, "labels").select(F.col("doc_id").alias("path"), "quality").join(doc, "path")
    m = lab.select("path", F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" "))), 256).alias("sha256"))
    return V.manifest_diff(doc.select("path", F.sha2("text", 256).alias("sha256")), m)


@query("invariance_check", with_(RUNS_K, select="""SELECT planning_mode, count(*) AS cells, round(avg((hi - lo <= 1e-9)::INT), 9) AS identical_fraction
    FROM (SELECT dataset, planning_seed, planning_mode, max("T") AS hi, min("T") AS lo FROM runs GROUP BY ALL HAVING count(*) > 1) GROUP BY planning_mode"""))
def _(spark, d):
    return rounded(V.invariance_check(A.runs(spark, d, True), KEYS, "planning_mode", "T"))


@query("pre_event_identity", with_(RUNS, select="""SELECT round(max(abs(a."P_detect" - r."P_detect")), 9) AS max_abs_diff, bool_and(abs(a."P_detect" - r."P_detect") < 1e-12) AS value_all_equal, bool_and(a.initial_positions_hash = r.initial_positions_hash) AS initial_positions_hash_all_equal,
    bool_and(a."T" = r."T") AS "T_all_equal", count(*) AS trials FROM (SELECT * FROM runs WHERE planning_mode = 'A') a JOIN (SELECT * FROM runs WHERE planning_mode = 'R') r USING (dataset, planning_seed)"""))
def _(spark, d):
    return rounded(V.pre_event_identity(_runs(spark, d), KEYS, "planning_mode", "A", "R", "P_detect", ["initial_positions_hash", "T"]))


@query("finite_check", with_(RUNS, select='SELECT planning_mode, bool_and(isfinite("P_detect") AND isfinite("RMST")) AS all_finite, count(*) AS n FROM runs GROUP BY 1'))
def _(spark, d):
    return V.finite_check(_runs(spark, d), "planning_mode", ["P_detect", "RMST"])


# ---- pairing --------------------------------------------------------------------------------------------------------


@query("detect_keys", with_(RUNS, select="SELECT 'dataset,seed' AS keys, count(DISTINCT (dataset, planning_seed)) AS n_cells FROM runs"))
def _(spark, d):
    r = _runs(spark, d).withColumnRenamed("planning_seed", "seed")
    k = P.detect_keys(r)
    return r.select(*k).distinct().agg(F.lit(",".join(k)).alias("keys"), F.count("*").alias("n_cells"))


@query("paired_matrix", with_(RUNS, select="""SELECT dataset, planning_seed, round(max("P_detect") FILTER (planning_mode = 'A'), 9) AS "A", round(max("P_detect") FILTER (planning_mode = 'N'), 9) AS "N", round(max("P_detect") FILTER (planning_mode = 'R'), 9) AS "R" FROM runs GROUP BY ALL"""))
def _(spark, d):
    return rounded(P.paired_matrix(_runs(spark, d), KEYS, "planning_mode", ARMS, "P_detect"))


@query("paired_matrix_avg", with_(RUNS_K, select="""SELECT dataset, planning_seed, round(avg("P_detect") FILTER (planning_mode = 'A'), 9) AS "A", round(avg("P_detect") FILTER (planning_mode = 'N'), 9) AS "N", round(avg("P_detect") FILTER (planning_mode = 'R'), 9) AS "R" FROM runs GROUP BY ALL"""))
def _(spark, d):
    return rounded(P.paired_matrix(A.runs(spark, d, True), KEYS, "planning_mode", ARMS, "P_detect", "avg"))


@query("paired_contrasts", with_(RUNS, select="""SELECT dataset, planning_seed, round(r."P_detect" - a."P_detect", 9) AS "dPdet", round((a."RMST" - r."RMST") / 51.0, 9) AS "dRMST_rel", round(r."L" - a."L", 9) AS "dL", 51 AS "H_common",
    round(a.exposure_multiplicity, 9) AS exposure_multiplicity_control, round(a.revisit_fraction, 9) AS revisit_fraction_control, round(r.exposure_multiplicity, 9) AS exposure_multiplicity_method, round(r.revisit_fraction, 9) AS revisit_fraction_method,
    a.initial_positions_hash FROM (SELECT * FROM runs WHERE planning_mode = 'A') a JOIN (SELECT * FROM runs WHERE planning_mode = 'R') r USING (dataset, planning_seed)"""))
def _(spark, d):
    return rounded(P.paired_contrasts(_runs(spark, d), KEYS, "A", "R", metadata=("initial_positions_hash",), carry=("exposure_multiplicity", "revisit_fraction")))


@query("paired_diff", with_(RUNS, CON, select='SELECT dataset, planning_seed, round("dRMST_rel", 9) AS diff FROM con'))
def _(spark, d):
    return rounded(P.paired_diff(_runs(spark, d), KEYS, "dRMST_rel", "R", "A"))


@query("paired_vector", with_(RUNS, CON, select='SELECT dataset, planning_seed, round("dL", 9) AS diff FROM con'))
def _(spark, d):
    return rounded(P.paired_diff(_runs(spark, d), KEYS, "L", "R", "A"))


RET = """
ret AS (SELECT r.*, CASE WHEN b."P_detect" > 0 THEN r."P_detect" / b."P_detect" END AS ret, CASE WHEN b."P_detect" IS NULL THEN 'no_k0_baseline' WHEN b."P_detect" <= 0 THEN 'baseline_P_detect_zero' ELSE 'none' END AS reason,
    r."RMST" / 51 - b."RMST" / 51 AS deg FROM runs r LEFT JOIN (SELECT * FROM runs WHERE k = 0) b ON r.dataset = b.dataset AND r.planning_seed = b.planning_seed AND r.planning_mode = b.planning_mode)"""


def _ret(spark, d):
    r = A.runs(spark, d, True).withColumn("NRMST", F.col("RMST") / F.col("H_common"))
    return P.retention(r, KEYS + ["planning_mode"], F.col("k") == 0)


@query("retention", with_(RUNS_K, RET, select='SELECT dataset, planning_seed, k, planning_mode, round(ret, 9) AS "retention_P_detect", reason AS retention_invalid_reason, round(deg, 9) AS "degradation_NRMST" FROM ret'))
def _(spark, d):
    return rounded(_ret(spark, d).select(*KEYS, "k", "planning_mode", "retention_P_detect", "retention_invalid_reason", "degradation_NRMST"))


@query("retention_at_reference", with_(RUNS_K, select="""SELECT r.dataset, r.planning_seed, r.k, r.planning_mode, round(CASE WHEN b."L" > 0 THEN r."L" / b."L" END, 9) AS "retention_L", round(r."RMST" - b."RMST", 9) AS "degradation_RMST"
    FROM runs r LEFT JOIN (SELECT * FROM runs WHERE k = 0) b ON r.dataset = b.dataset AND r.planning_seed = b.planning_seed AND r.planning_mode = b.planning_mode"""))
def _(spark, d):
    r = P.retention(A.runs(spark, d, True), KEYS + ["planning_mode"], F.col("k") == 0, "L", "RMST")
    return rounded(r.select(*KEYS, "k", "planning_mode", "retention_L", "degradation_RMST"))


@query("retention_contrasts", with_(RUNS_K, RET, select="""SELECT dataset, planning_seed, k, round(a.ret - b.ret, 9) AS "dRetention_Pdet", round(b.deg - a.deg, 9) AS "dDegradation_NRMST", round(a."P_detect" - b."P_detect", 9) AS "dPdet", round((b."RMST" - a."RMST") / 51.0, 9) AS "dRMST_rel"
    FROM (SELECT * FROM ret WHERE k > 0 AND planning_mode = 'R') a FULL JOIN (SELECT * FROM ret WHERE k > 0 AND planning_mode = 'A') b USING (dataset, planning_seed, k)"""))
def _(spark, d):
    return rounded(P.retention_contrasts(_ret(spark, d).where("k > 0"), KEYS + ["k"], "R", "A"))


@query("all_pairs_contrasts", with_(RUNS, """
ap AS (SELECT a.dataset, a.planning_seed, a.planning_mode AS "first", b.planning_mode AS "second", a."P_detect" - b."P_detect" AS dp, (b."RMST" - a."RMST") / 51.0 AS dr, a."L" - b."L" AS dl
    FROM runs a JOIN runs b ON a.dataset = b.dataset AND a.planning_seed = b.planning_seed AND a.planning_mode < b.planning_mode)""", select="""SELECT dataset, planning_seed, "first", "second", round(dp, 9) AS "dPdet", round(dr, 9) AS "dRMST_rel", round(dl, 9) AS "dL" FROM ap"""))
def _(spark, d):
    return rounded(P.all_pairs_contrasts(_runs(spark, d), KEYS, [("A", "N"), ("A", "R"), ("N", "R")]))


@query("factorial_contrasts", with_("""
b0 AS (SELECT CAST(s_nationkey AS INT) AS dataset, CAST(l_suppkey AS INT) AS planning_seed, (l_returnflag = 'R')::INT AS f1, (l_linestatus = 'O')::INT AS f2, avg(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
w AS (SELECT dataset, planning_seed, max(v) FILTER (f1 = 0 AND f2 = 0) AS s1, max(v) FILTER (f1 = 0 AND f2 = 1) AS s3, max(v) FILTER (f1 = 1 AND f2 = 0) AS d1, max(v) FILTER (f1 = 1 AND f2 = 1) AS d3 FROM b0 GROUP BY ALL)""",
                                     select='SELECT dataset, planning_seed, round(d1 - s1, 9) AS "D1", round(d3 - s3, 9) AS "D3", round((d3 - s3) - (d1 - s1), 9) AS "I", round(s3 - s1, 9) AS "H_S", round(d3 - d1, 9) AS "H_D" FROM w'))
def _(spark, d):
    return rounded(P.factorial_contrasts(four_arms(spark, d), KEYS, "L", "static", "static_3step", "dynamic", "dynamic_3step"))


def four_arms(spark, d):
    li, su = A.table(spark, d, "lineitem"), A.table(spark, d, "supplier")
    mode = F.concat(F.when(F.col("l_returnflag") == "R", "dynamic").otherwise("static"), F.when(F.col("l_linestatus") == "O", "_3step").otherwise(""))
    j = li.join(su, li.l_suppkey == su.s_suppkey).select(F.col("s_nationkey").cast("int").alias("dataset"), F.col("l_suppkey").cast("int").alias("planning_seed"), mode.alias("planning_mode"), "l_quantity")
    return j.groupBy(*KEYS, "planning_mode").agg(F.avg("l_quantity").alias("L"))


@query("code_factors", with_("""
f AS (SELECT CAST(s_nationkey AS INT) AS dataset, CAST(l_suppkey AS INT) AS planning_seed, (CASE WHEN l_returnflag = 'R' THEN 'dynamic' ELSE 'static' END) || (CASE WHEN l_linestatus = 'O' THEN '_3step' ELSE '' END) AS planning_mode,
    (l_returnflag = 'R')::INT AS dynamism, (l_linestatus = 'O')::INT AS horizon, round(avg(l_quantity), 9) AS "L" FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)""", select="SELECT * FROM f"))
def _(spark, d):
    return rounded(P.code_factors(four_arms(spark, d), FACTORS))


FACTORS = {"static": (0, 0), "dynamic": (1, 0), "static_3step": (0, 1), "dynamic_3step": (1, 1)}


@query("join_one_to_one", with_(RUNS, select="""SELECT dataset, round(m, 9) AS mean_dp, n_name AS environment_type, n_regionkey AS climate FROM (SELECT dataset, avg("P_detect") AS m FROM runs GROUP BY 1) LEFT JOIN nation ON n_nationkey = dataset"""))
def _(spark, d):
    m = _runs(spark, d).groupBy("dataset").agg(F.avg("P_detect").alias("mean_dp"))
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("dataset"), F.col("n_name").alias("environment_type"), F.col("n_regionkey").alias("climate"))
    return rounded(P.join_one_to_one(m, n, ["dataset"]))


@query("cluster_means", with_(RUNS, CON, select="""SELECT dataset, round(avg("dPdet"), 9) AS "mean_dPdet", round(avg("dRMST_rel"), 9) AS "mean_dRMST_rel", round(avg("dL"), 9) AS "mean_dL", count(*) AS n FROM con GROUP BY 1"""))
def _(spark, d):
    return rounded(P.cluster_means(_con(spark, d), ["dataset"], ["dPdet", "dRMST_rel", "dL"]))


@query("semi_keys", "SELECT o_orderkey, o_custkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return P.semi_keys(o, A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("common_keys", "SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def _(spark, d):
    return P.common_keys(A.table(spark, d, "orders"), A.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("arm_filter", "SELECT l_orderkey, l_linenumber, CAST(regexp_extract(p_brand, 'Brand#([0-9]+)', 1) AS INT) AS brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.02 AND 0.06")
def _(spark, d):
    li = A.table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & F.col("l_discount").between(0.02, 0.06))
    return li.join(A.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.regexp_extract("p_brand", "Brand#([0-9]+)", 1).cast("int").alias("brand"))


# ---- curves: one price curve per (supplier, arm) over the ship month ---------------------------------------------------

CURVE = """
cv0 AS (SELECT CAST(l_suppkey AS INT) AS planning_seed, l_returnflag AS planning_mode, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INT) AS step, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
cv AS (SELECT planning_seed, planning_mode, step, CAST(sum(q) OVER w AS DOUBLE) / 10000.0 AS "L_cumulative", greatest(0.0, CAST(sum(q) OVER w - 500 AS DOUBLE)) AS distance_post_fault FROM cv0 WINDOW w AS (PARTITION BY planning_seed, planning_mode ORDER BY step))"""
CK = ["planning_seed", "planning_mode"]


def curve(spark, d):
    from coverlens.operators.scan import running_sums

    c = A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("planning_seed"), F.col("l_returnflag").alias("planning_mode"),
                                              ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("int").alias("step")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    r = running_sums(c, CK, "step", {"s": F.col("q")})
    return r.select(*CK, "step", (F.col("s").cast("double") / 10000.0).alias("L_cumulative"), F.greatest(F.lit(0.0), (F.col("s") - 500).cast("double")).alias("distance_post_fault"))


@query("asof_sample", with_(CURVE, select='SELECT planning_seed, planning_mode, round(arg_max("L_cumulative", step), 9) AS "L_cumulative_at", max(step) AS step_at FROM cv WHERE step <= 40 GROUP BY ALL'))
def _(spark, d):
    return rounded(P.asof_sample(curve(spark, d), CK, "step", "L_cumulative", 40))


@query("interp_mean_curve", with_(CURVE, """
g AS (SELECT CAST(unnest(range(0, 91, 5)) AS DOUBLE) AS grid),
nx AS (SELECT *, lead(step) OVER w AS ns, lead("L_cumulative") OVER w AS nl, min(step) OVER (PARTITION BY planning_seed, planning_mode) AS fs, max(step) OVER (PARTITION BY planning_seed, planning_mode) AS ls FROM cv WINDOW w AS (PARTITION BY planning_seed, planning_mode ORDER BY step)),
iv AS (SELECT planning_mode, grid, CASE WHEN grid <= step OR ns IS NULL THEN "L_cumulative" ELSE "L_cumulative" + (grid - step) / (ns - step) * (nl - "L_cumulative") END AS v
    FROM g JOIN nx ON (grid >= step AND (grid < ns OR ns IS NULL)) OR (step = fs AND grid < step))""", select='SELECT planning_mode, grid, round(avg(v), 9) AS "mean_L_cumulative", count(*) AS n FROM iv GROUP BY ALL'))
def _(spark, d):
    return rounded(P.interp_mean_curve(curve(spark, d), CK, ["planning_mode"], "step", "L_cumulative", 5.0, 90.0))


PAD = """
px AS (SELECT planning_seed, planning_mode, row_number() OVER (PARTITION BY planning_seed, planning_mode ORDER BY step) - 1 AS idx, "L_cumulative" AS v FROM cv),
pm AS (SELECT planning_mode, max(idx) AS m FROM px GROUP BY 1), pe AS (SELECT planning_seed, planning_mode, max(idx) AS e, arg_max(v, idx) AS lv FROM px GROUP BY ALL),
pp AS (SELECT planning_mode, idx, v FROM px UNION ALL SELECT planning_mode, idx, lv FROM (SELECT planning_mode, unnest(range(e + 1, m + 1)) AS idx, lv FROM pe JOIN pm USING (planning_mode)))"""


def _padded(spark, d):
    from coverlens.operators.scan import running_sums

    c = running_sums(curve(spark, d), CK, "step", {"i": F.lit(1)}).withColumn("idx", (F.col("i") - 1).cast("bigint")).select(*CK, "idx", "L_cumulative")
    return P.padded_curve(c, CK, ["planning_mode"], "idx", "L_cumulative")


@query("padded_mean", with_(CURVE, PAD, select="SELECT planning_mode, idx, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v) / sqrt(count(*)), 9) AS se FROM pp GROUP BY ALL"))
def _(spark, d):
    return rounded(moments(_padded(spark, d), ["planning_mode", "idx"], "L_cumulative").select("planning_mode", "idx", "n", "mean", "se"))


PAD_CI = "pc AS (SELECT planning_mode, idx, count(*) AS n, avg(v) AS mean, stddev_samp(v) / sqrt(count(*)) AS se FROM pp GROUP BY ALL)"


@query("padded_mean_ci", with_(CURVE, PAD, PAD_CI, t_quantile("pq", "pc", 0.975), select="""SELECT planning_mode, idx, n, round(mean, 9) AS mean, round(mean - q * se, 9) AS ci_lo, round(mean + q * se, 9) AS ci_hi FROM pc LEFT JOIN pq ON nu = n - 1"""))
def _(spark, d):
    from coverlens.operators.stats import mean_ci

    return rounded(mean_ci(_padded(spark, d), ["planning_mode", "idx"], "L_cumulative").select("planning_mode", "idx", "n", "mean", "ci_lo", "ci_hi"))


@query("post_event_efficiency", with_(CURVE, """
pe AS (SELECT planning_seed, planning_mode, coalesce(arg_max("L_cumulative", step) FILTER (distance_post_fault = 0), 0.0) AS a, arg_min("L_cumulative", step) FILTER (distance_post_fault > 0) AS f, arg_max("L_cumulative", step) AS e, arg_max(distance_post_fault, step) AS dist,
    count(*) FILTER (distance_post_fault > 0) AS n FROM cv GROUP BY ALL)""", select="""SELECT planning_seed, planning_mode, round(a, 9) AS "L_at_fault_curve", round(f, 9) AS "L_postfault_first_sample", round(e, 9) AS "L_end", round(e - a, 9) AS postfault_mass_gain, round(dist, 6) AS postfault_distance,
    round(CASE WHEN dist > 0 THEN (e - a) / dist END, 9) AS postfault_mass_efficiency FROM pe WHERE n > 0"""))
def _(spark, d):
    return rounded(P.post_event_efficiency(curve(spark, d), CK), 9, postfault_distance=6)


# ---- summaries ------------------------------------------------------------------------------------------------------


@query("describe_arms", with_(RUNS, select="""SELECT dataset, planning_mode, round(avg("P_detect"), 9) AS mean, round(stddev_samp("P_detect"), 9) AS std, count(*) AS n, round(stddev_samp("P_detect") / sqrt(count(*)), 9) AS se FROM runs GROUP BY ALL"""))
def _(spark, d):
    return rounded(M.describe_arms(_runs(spark, d), ["dataset", "planning_mode"], "P_detect"))


@query("descriptives", """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, count(*) AS n, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS se, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
    round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders GROUP BY 1""")
def _(spark, d):
    return rounded(M.descriptives(A.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), 4)


@query("summary_ci", with_(RUNS, select="""SELECT planning_mode, round(avg("P_detect"), 9) AS "mean_P_detect", round(1.96 * stddev_samp("P_detect") / sqrt(count(*)), 9) AS "ci_P_detect", round(avg("L"), 9) AS "mean_L", round(1.96 * stddev_samp("L") / sqrt(count(*)), 9) AS "ci_L", count(*) AS n FROM runs GROUP BY 1"""))
def _(spark, d):
    return rounded(M.summary_ci(_runs(spark, d), ["planning_mode"], ["P_detect", "L"]))


SM_COLS = ["mean", "sd", "se", "ci_lo", "ci_hi", "tost_p_lower", "tost_p_upper", "tost_p_max"]


def sm_select(by: str, src: str = "sm") -> str:
    cols = [f'round("{e}_{c}", 8) AS "{e}_{c}"' for e in ("dPdet", "dRMST_rel") for c in SM_COLS]
    cols += [f'"{e}_{c}"' for e in ("dPdet", "dRMST_rel") for c in ("favorable_count", "non_adverse_count", "equivalent", "state")]
    return f"SELECT {by}, n, {', '.join(cols)}, state FROM {src}"


def sm_frame(df, by):
    t = M.summary_table(df, by)
    cols = [f"{e}_{c}" for e in ("dPdet", "dRMST_rel") for c in SM_COLS + ["favorable_count", "non_adverse_count", "equivalent", "state"]]
    return rounded(t.select(*by, F.col("dPdet_n").alias("n"), *cols, "state"), 8)


@query("summary_table", with_(RUNS, CON, summary("con", "dataset"), select=sm_select("dataset")))
def _(spark, d):
    return sm_frame(_con(spark, d), ["dataset"])


@query("summary_table_levels", with_(RUNS_K, CON_K, summary("con", "dataset, k"), select=sm_select("dataset, k")))
def _(spark, d):
    return sm_frame(_con_k(spark, d), ["dataset", "k"])


@query("resummarize_contrasts", with_(RUNS_K, CON_K, summary("con", "k"), select=sm_select("k")))
def _(spark, d):
    return sm_frame(_con_k(spark, d), ["k"])




def op_sql(by: str) -> str:
    c = lambda x, q: f'"{x}_mean" - {q}.q * "{x}_sd" / sqrt(n) AS "{x}_{q}_lo", "{x}_mean" + {q}.q * "{x}_sd" / sqrt(n) AS "{x}_{q}_hi"'
    i = lambda x, m: f'coalesce("{x}_mean" >= {m} AND "{x}_q95_lo" > 0, false)'
    w = lambda x, m: f'coalesce("{x}_mean" <= -{m} AND "{x}_q95_hi" < 0, false)'
    e = lambda x, m: f'coalesce("{x}_q90_lo" > -{m} AND "{x}_q90_hi" < {m}, false)'
    good, bad = f"({i('dPdet', .01)} OR {i('dRMST_rel', .02)})", f"({w('dPdet', .01)} OR {w('dRMST_rel', .02)})"
    same = f"({e('dPdet', .01)} AND {e('dRMST_rel', .02)})"
    return (f"""
om AS (SELECT {by}, count(*) AS n, avg("dPdet") AS "dPdet_mean", stddev_samp("dPdet") AS "dPdet_sd", avg("dRMST_rel") AS "dRMST_rel_mean", stddev_samp("dRMST_rel") AS "dRMST_rel_sd", avg("dL") AS "mean_dL",
    count(*) FILTER ("dPdet" > 0) AS fd, count(*) FILTER ("dRMST_rel" > 0) AS fr FROM con GROUP BY {by}),{t_quantile('q95', 'om', .975)},{t_quantile('q90', 'om', .95)},
oc AS (SELECT om.*, {c('dPdet', 'q95')}, {c('dPdet', 'q90')}, {c('dRMST_rel', 'q95')}, {c('dRMST_rel', 'q90')} FROM om LEFT JOIN q95 ON q95.nu = n - 1 LEFT JOIN q90 ON q90.nu = n - 1),
ov AS (SELECT *, CASE WHEN {bad} AND NOT {good} THEN 'RED' WHEN {good} AND NOT {bad} THEN 'GREEN' WHEN {good} AND {bad} THEN 'MIXED' WHEN {same} AND "mean_dL" >= 0.01 THEN 'INTERMEDIATE' WHEN {same} THEN 'NO_BENEFIT' ELSE 'INCONCLUSIVE' END AS verdict FROM oc)""")


@query("operational_summary", with_(RUNS_K, CON_K, op_sql("k"), select="""SELECT k, n AS "dPdet_n", n AS "dRMST_rel_n", round("dPdet_mean", 9) AS "dPdet_mean", round("dPdet_sd", 9) AS "dPdet_sd", round("dPdet_q95_lo", 8) AS "dPdet_ci95_lo", round("dPdet_q95_hi", 8) AS "dPdet_ci95_hi",
    round("dPdet_q90_lo", 8) AS "dPdet_ci90_lo", round("dPdet_q90_hi", 8) AS "dPdet_ci90_hi", fd AS "dPdet_favorable_count", round("dRMST_rel_mean", 9) AS "dRMST_rel_mean", round("dRMST_rel_sd", 9) AS "dRMST_rel_sd", round("dRMST_rel_q95_lo", 8) AS "dRMST_rel_ci95_lo",
    round("dRMST_rel_q95_hi", 8) AS "dRMST_rel_ci95_hi", round("dRMST_rel_q90_lo", 8) AS "dRMST_rel_ci90_lo", round("dRMST_rel_q90_hi", 8) AS "dRMST_rel_ci90_hi", fr AS "dRMST_rel_favorable_count", round("mean_dL", 9) AS "mean_dL", verdict FROM ov"""))
def _(spark, d):
    ci = {f"{e}_ci{l}_{s}": 8 for e in ("dPdet", "dRMST_rel") for l in (95, 90) for s in ("lo", "hi")}
    return rounded(M.operational_summary(_con_k(spark, d), ["k"]), 9, **ci)


@query("verdict", with_(RUNS_K, CON_K, op_sql("dataset, k"), select="SELECT dataset, k, verdict FROM ov"))
def _(spark, d):
    return M.operational_summary(_con_k(spark, d), ["dataset", "k"]).select("dataset", "k", "verdict")


@query("response_surface", with_(RUNS_K, CON_K, select='SELECT dataset, k, round(avg("dPdet"), 9) AS "mean_dPdet", round(avg("dRMST_rel"), 9) AS "mean_dRMST_rel", round(avg("dL"), 9) AS "mean_dL", count(*) AS n FROM con GROUP BY ALL'))
def _(spark, d):
    return rounded(M.response_surface(_con_k(spark, d), ["dataset", "k"]))


@query("delta_summary", with_(RUNS_K, CON_K, select='SELECT k, count(*) AS n, round(avg("dL"), 9) AS mean_delta, round(max(abs("dL")), 9) AS max_abs_delta, round(avg((abs("dL") > 1e-6)::INT), 9) AS pct_changed, round(median(abs("dL")), 9) AS median_abs_delta FROM con GROUP BY k'))
def _(spark, d):
    return rounded(M.delta_summary(_con_k(spark, d), ["k"], "dL"))


@query("timing_summary", with_(RUNS_K, """
tm AS (SELECT 'dynamic_' || (k + 1) || 'step' AS planning_mode, dataset % 3 AS fleet, planner_wall_time, number_of_replans FROM runs)""", select="""SELECT CAST(regexp_extract(planning_mode, '([0-9]+)step', 1) AS INT) AS horizon, fleet, count(*) AS n, round(avg(planner_wall_time), 8) AS planner_wall_time_mean,
    round(stddev_samp(planner_wall_time), 8) AS planner_wall_time_sd, round(avg(number_of_replans), 8) AS replans_mean, round(1000.0 * avg(planner_wall_time) / avg(number_of_replans), 6) AS planner_ms_per_replan FROM tm GROUP BY ALL"""))
def _(spark, d):
    r = A.runs(spark, d, True).select(F.concat(F.lit("dynamic_"), F.col("k") + 1, F.lit("step")).alias("planning_mode"), (F.col("dataset") % 3).alias("fleet"), "planner_wall_time", "number_of_replans")
    return rounded(M.timing_summary(r, "planning_mode", "fleet"), 8, planner_ms_per_replan=6)


@query("overhead", with_(RUNS, select='SELECT planning_mode, round(m, 8) AS mean, n, round((m / min(m) OVER () - 1) * 100, 7) AS overhead_pct FROM (SELECT planning_mode, avg(planner_wall_time) AS m, count(*) AS n FROM runs GROUP BY 1)'))
def _(spark, d):
    return rounded(M.overhead(_runs(spark, d), ["planning_mode"], "planner_wall_time"), 8, overhead_pct=7)


@query("crossover_point", with_(RUNS_K, """
cx AS (SELECT k, avg("RMST") FILTER (planning_mode = 'R') / avg("RMST") FILTER (planning_mode = 'A') AS ratio FROM runs GROUP BY k)""", select="SELECT min(k) FILTER (ratio > 1) AS crossover, count(ratio) AS levels, round(max(ratio), 9) AS max_ratio FROM cx"))
def _(spark, d):
    return rounded(M.crossover_point(A.runs(spark, d, True), "k", "planning_mode", "R", "A", "RMST"))


@query("breakdown", """SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean_o_totalprice, round(count(*) / (SELECT count(*) FROM orders), 9) AS fraction FROM orders GROUP BY 1""")
def _(spark, d):
    return rounded(M.breakdown(A.table(spark, d, "orders"), "o_orderstatus", ["o_totalprice"]), 9, mean_o_totalprice=4)


@query("top_arms", """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 3""")
def _(spark, d):
    return rounded(M.top_arms(A.table(spark, d, "orders"), "o_orderpriority", "o_totalprice", 3), 4)


@query("association", """WITH r AS (SELECT l_returnflag, l_quantity, l_extendedprice, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0) AS a,
    (rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0) AS b FROM lineitem)
    SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS pearson, round(corr(a, b), 8) AS spearman, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM r GROUP BY 1""")
def _(spark, d):
    return rounded(M.association(A.table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 8, slope=5, intercept=4)


@query("rollup_means", with_(RUNS, select="""SELECT dataset, planning_mode, round(avg("P_detect"), 9) AS mean, count(*) AS n, CASE WHEN grouping(dataset) = 1 THEN 'global' ELSE 'cluster' END AS grain FROM runs GROUP BY GROUPING SETS ((dataset, planning_mode), (planning_mode))"""))
def _(spark, d):
    return rounded(M.rollup_means(_runs(spark, d), "dataset", ["planning_mode"], "P_detect"))


@query("first_adverse_level", with_(RUNS_K, CON_K, summary("con", "dataset, k"), """
fa AS (SELECT k, count(*) FILTER (state = 'WORSENING') AS w FROM sm GROUP BY k)""", select="SELECT min(k) FILTER (w > 0) AS first_adverse, arg_min(w, k) FILTER (w > 0) AS clusters, count(*) AS levels FROM fa"))
def _(spark, d):
    return M.first_adverse_level(M.summary_table(_con_k(spark, d), ["dataset", "k"]), "k", "dataset")


@query("gap_to_worst", """SELECT o_orderpriority, o_orderstatus, round(m, 4) AS mean, round(s, 4) AS std, n, round(100 * (m - min(m) OVER w) / min(m) OVER w, 8) AS gap_pct FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY ALL)
    WINDOW w AS (PARTITION BY o_orderpriority)""")
def _(spark, d):
    return rounded(M.gap_to_worst(A.table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice"), 4, gap_pct=8)


@query("minmax_scale", """SELECT o_orderpriority, o_orderstatus, round(m, 4) AS mean, round(CASE WHEN max(m) OVER w = min(m) OVER w THEN 1.0 ELSE (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) END, 8) AS scaled
    FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY ALL) WINDOW w AS (PARTITION BY o_orderpriority)""")
def _(spark, d):
    return rounded(M.minmax_scale(A.table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice"), 4, scaled=8)


# ---- classification ---------------------------------------------------------------------------------------------------

SMD, SMK = summary("con", "dataset"), summary("con", "dataset, k")


@query("classify_endpoint", with_(RUNS, CON, SMD, select='SELECT dataset, "dPdet_state", "dRMST_rel_state" FROM sm'))
def _(spark, d):
    return M.summary_table(_con(spark, d), ["dataset"]).select("dataset", "dPdet_state", "dRMST_rel_state")


@query("classify_joint", with_(RUNS_K, CON_K, SMK, select="SELECT dataset, k, state FROM sm"))
def _(spark, d):
    return M.summary_table(_con_k(spark, d), ["dataset", "k"]).select("dataset", "k", "state")


@query("state_shares", with_(RUNS_K, CON_K, SMK, select="""SELECT k, count(*) AS n, count(*) FILTER (state = 'IMPROVEMENT') AS n_improvement, count(*) FILTER (state = 'WORSENING') AS n_worsening, count(*) FILTER (state = 'EQUIVALENT') AS n_equivalent,
    count(*) FILTER (state = 'INCONCLUSIVE') AS n_inconclusive, round(1 - count(*) FILTER (state = 'WORSENING') / count(*), 9) AS non_adverse_fraction FROM sm GROUP BY k"""))
def _(spark, d):
    return rounded(K.state_shares(M.summary_table(_con_k(spark, d), ["dataset", "k"]), ["k"]))


GLB = """
gm AS (SELECT dataset, avg("dPdet") AS "dPdet", avg("dRMST_rel") AS "dRMST_rel", 1 AS one FROM con GROUP BY 1)"""


def _global_rows(spark, d):
    """Cluster-level endpoint rows with t intervals (the bootstrap interval has its own query)."""
    c = _con(spark, d).groupBy("dataset").agg(F.avg("dPdet").alias("dPdet"), F.avg("dRMST_rel").alias("dRMST_rel")).withColumn("one", F.lit(1))
    t = M.summary_table(c, ["one"])
    row = lambda e, m: t.select(F.lit(e).alias("endpoint"), F.col(f"{e}_mean").alias("mean"), F.col(f"{e}_ci_lo").alias("ci_lo"), F.lit(m).alias("margin"), F.col(f"{e}_state").alias("classification"))
    return row("dPdet", 0.01).unionByName(row("dRMST_rel", 0.02))


@query("generalization_gate", with_(RUNS, CON, SMD, GLB, summary("gm", "one", "g"), """
e AS (SELECT count(*) FILTER (state <> 'WORSENING') AS non_adverse, count(*) FILTER (state = 'IMPROVEMENT') AS positive, count(*) AS clusters FROM sm),
x AS (SELECT e.*, "dPdet_mean" > 0 OR "dRMST_rel_mean" > 0 AS global_mean_positive, "dPdet_state" <> 'WORSENED' AND "dRMST_rel_state" <> 'WORSENED' AS global_not_worse,
    coalesce("dPdet_ci_lo" >= -0.01, false) AND coalesce("dRMST_rel_ci_lo" >= -0.02, false) AS lower_ok FROM e, g)""", select="""SELECT *, CASE WHEN non_adverse >= 14 AND positive >= 12 AND lower_ok THEN 'GENERALIZES' WHEN global_mean_positive AND global_not_worse THEN 'HETEROGENEOUS' ELSE 'LIMITED' END AS gate FROM x"""))
def _(spark, d):
    return K.generalization_gate(M.summary_table(_con(spark, d), ["dataset"]), _global_rows(spark, d), 14, 12)


@query("robustness_gate", with_(RUNS_K, CON_K, SMK, """
ah AS (SELECT bool_or(a >= 0.5) AS adverse_half FROM (SELECT k, avg((state = 'WORSENING')::INT) AS a FROM sm GROUP BY k)),
rs AS (SELECT avg((state <> 'WORSENING')::INT) AS na, avg(("dPdet_mean" > 0 AND "dRMST_rel_mean" > 0)::INT) AS bp, avg((state = 'IMPROVEMENT')::INT) AS pi FROM sm)""", select="""SELECT round(na, 9) AS non_adverse, round(bp, 9) AS both_positive, round(pi, 9) AS practical_improvement, adverse_half,
    CASE WHEN adverse_half THEN 'FRAGILE' WHEN na >= 0.75 AND bp >= 0.6 AND pi >= 0.6 THEN 'ROBUST' ELSE 'SENSITIVE' END AS gate FROM rs, ah"""))
def _(spark, d):
    return rounded(K.robustness_gate(M.summary_table(_con_k(spark, d), ["dataset", "k"]), "k"))


ATT = ",".join([contrasts("c1", "runs", "dataset, planning_seed, k", "A", "R"), contrasts("c2", "runs", "dataset, planning_seed, k", "N", "R"), contrasts("c3", "runs", "dataset, planning_seed, k", "N", "A"), """
con AS (SELECT 'online' AS comparator, * FROM c1 WHERE k >= 1 UNION ALL SELECT 'geometric', * FROM c2 WHERE k >= 1 UNION ALL SELECT 'online_geometric', * FROM c3 WHERE k >= 1)"""])


@query("attrition_gate", with_(RUNS_K, ATT, summary("con", "comparator, dataset, k"), """
pk AS (SELECT comparator, k, ceil(2 * count(*) / 3.0) AS need, count(*) FILTER (state = 'EQUIVALENT') AS e, count(*) FILTER (state = 'IMPROVEMENT') AS i, count(*) FILTER (state = 'WORSENING') AS w FROM sm GROUP BY ALL),
ag AS (SELECT coalesce(bool_and(w = 0) FILTER (comparator = 'geometric') AND count(*) FILTER (comparator = 'geometric') = (SELECT count(DISTINCT k) FROM sm), false) AND coalesce(bool_and(w = 0) FILTER (comparator = 'online') AND count(*) FILTER (comparator = 'online') = (SELECT count(DISTINCT k) FROM sm), false) AS no_worsening, coalesce(bool_and(e >= need) FILTER (comparator = 'geometric') AND count(*) FILTER (comparator = 'geometric') = (SELECT count(DISTINCT k) FROM sm), false) AS geometric_equivalent, coalesce(bool_and(e >= need) FILTER (comparator = 'online') AND count(*) FILTER (comparator = 'online') = (SELECT count(DISTINCT k) FROM sm), false) AS online_equivalent,
    coalesce(bool_and(i >= need) FILTER (comparator = 'online_geometric') AND count(*) FILTER (comparator = 'online_geometric') = (SELECT count(DISTINCT k) FROM sm), false) AS online_improved, coalesce(bool_and(e + i >= need) FILTER (comparator = 'online') AND count(*) FILTER (comparator = 'online') = (SELECT count(DISTINCT k) FROM sm), false) AS online_ok, coalesce(bool_and(e + i >= need) FILTER (comparator = 'geometric') AND count(*) FILTER (comparator = 'geometric') = (SELECT count(DISTINCT k) FROM sm), false) AS geometric_ok FROM pk)""",
                               select="""SELECT *, CASE WHEN geometric_equivalent THEN 'PIZZA_GAP_CLOSED' WHEN online_equivalent AND online_improved THEN 'ONLINE_REPLANNING_MAIN' WHEN no_worsening AND online_ok AND geometric_ok THEN 'GRACEFUL_REPLANNING' ELSE 'NO_DIFFERENTIAL_ADVANTAGE' END AS gate FROM ag"""))
def _(spark, d):
    r = A.runs(spark, d, True).where(F.col("k") >= 1)
    p = P.arm_pairs(r, KEYS + ["k"], "planning_mode", [("A", "R"), ("N", "R"), ("N", "A")], ["P_detect", "RMST", "H_common"])
    name = F.when((F.col("first") == "A"), "online").when(F.col("second") == "R", "geometric").otherwise("online_geometric")
    c = p.select(name.alias("comparator"), *KEYS, "k", (F.col("b_P_detect") - F.col("a_P_detect")).alias("dPdet"), ((F.col("a_RMST") - F.col("b_RMST")) / F.greatest("a_H_common", "b_H_common")).alias("dRMST_rel"))
    return K.attrition_gate(M.summary_table(c, ["comparator", "dataset", "k"]), "k", "comparator", "geometric", "online", "online_geometric")


@query("mismatch_gate", with_(RUNS_K, CON_K, SMK, """
pk AS (SELECT k, ceil(2 * count(*) / 3.0) AS need, count(*) FILTER (state = 'IMPROVEMENT') AS i, count(*) FILTER (state = 'WORSENING') AS w FROM sm GROUP BY k),
mg AS (SELECT bool_or(w > 0) AS any_worsening, bool_and(i >= need) AS all_improved, count(*) AS levels FROM pk)""", select="SELECT *, CASE WHEN any_worsening THEN 'INVERTS' WHEN all_improved THEN 'ROBUST_TO_MODERATE_MISMATCH' ELSE 'DEGRADES' END AS gate FROM mg"))
def _(spark, d):
    return K.mismatch_gate(M.summary_table(_con_k(spark, d), ["dataset", "k"]), "k")


@query("mobility_gate", with_(RUNS_K, CON_K, SMK, """
pk AS (SELECT k, ceil(2 * count(*) / 3.0) AS need, count(*) FILTER (state = 'IMPROVEMENT') AS i, count(*) FILTER (state = 'WORSENING') AS w FROM sm GROUP BY k),
mg AS (SELECT count(*) AS models, count(*) FILTER (w = 0 AND i >= need) AS passing, bool_or(w >= need) AS any_bad FROM pk),
hh AS (SELECT max(n) = 1 AS ok FROM (SELECT count(DISTINCT initial_positions_hash) AS n FROM runs GROUP BY dataset, planning_seed, k))""", select="""SELECT mg.*, CASE WHEN NOT ok THEN 'INVALID' WHEN any_bad THEN 'FAIL' WHEN passing >= ceil(2 * models / 3.0) THEN 'PASS' ELSE 'BOUNDARY' END AS gate FROM mg, hh"""))
def _(spark, d):
    g = V.group_constraints(A.runs(spark, d, True), KEYS + ["k"], 3, ["initial_positions_hash"])
    return K.mobility_gate(M.summary_table(_con_k(spark, d), ["dataset", "k"]), "k", g.select(F.col("bad_initial_positions_hash") == 0).scalar())


@query("sign_flip", with_(RUNS_K, CON_K, """
sf AS (SELECT dataset, avg("dPdet") FILTER (k = 0) AS lo, avg("dPdet") FILTER (k = 6) AS hi FROM con WHERE k IN (0, 6) GROUP BY 1),
sg AS (SELECT avg(lo) AS ml, avg(hi) AS mh, count(*) FILTER (sign(coalesce(lo, 0)) <> sign(coalesce(hi, 0))) AS flips FROM sf)""", select="SELECT round(ml, 9) AS mean_low, round(mh, 9) AS mean_high, flips, sign(coalesce(ml, 0)) <> sign(coalesce(mh, 0)) OR flips >= 2 AS boundary FROM sg"))
def _(spark, d):
    return rounded(K.sign_flip(_con_k(spark, d), "dataset", "k", 0, 6, "dPdet"))


@query("scenario_flags", with_(RUNS_K, CON_K, summary("con", "k"), select="""SELECT max("dPdet_state") FILTER (k = 1) = 'IMPROVED' AND max("dRMST_rel_state") FILTER (k = 1) <> 'WORSENED' AS system_performance,
    max("dPdet_state") FILTER (k = 2) <> 'IMPROVED' AS geometric_competitive, max("dPdet_state") FILTER (k = 3) <> 'WORSENED' AND max("dRMST_rel_state") FILTER (k = 3) <> 'WORSENED' AS no_loss FROM sm"""))
def _(spark, d):
    t = M.summary_table(_con_k(spark, d), ["k"])
    e = lambda n: t.select(F.concat(F.lit("P"), F.col("k")).alias("contrast"), F.lit(n).alias("endpoint"), F.col(f"{n}_state").alias("classification"))
    return K.scenario_flags(e("dPdet").unionByName(e("dRMST_rel")), {
        "system_performance": [("P1", "dPdet", "IMPROVED", True), ("P1", "dRMST_rel", "WORSENED", False)],
        "geometric_competitive": [("P2", "dPdet", "IMPROVED", False)],
        "no_loss": [("P3", "dPdet", "WORSENED", False), ("P3", "dRMST_rel", "WORSENED", False)]})
