"""Queries over belief maps and decision traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.operators import belief as B
from coverlens.operators import exposure as X
from coverlens.operators import traces as TR
from coverlens.operators.grid import footprint
from coverlens.plans.ctes import CELL, FOOT, PING, with_
from coverlens.plans.registry import query, rounded
from coverlens.sources import adapters as A

R, PD, TAU = 1.5, 0.8, 100.0


def _obs(spark, d, union=True):
    return B.observations(X.exposure_events(A.pings(spark, d), A.grid_spec(spark, d), R), union)


def _end(spark, d):
    return A.pings(spark, d).agg(F.max("t") + 1).first()[0] or 0


def fold(ell_at: str, limit: str = "", k: str = "1", extra: str = "") -> str:
    return f"""
ob AS (SELECT run_id, "row", col, t, {k} AS k FROM foot GROUP BY run_id, "row", col, t),
hs AS (SELECT run_id, "row", col{extra and ', ' + extra}, list({{'t': t::DOUBLE, 'k': k::DOUBLE, 'l': 1.0::DOUBLE}} ORDER BY t) AS h FROM ob {limit} GROUP BY ALL),
fo AS (SELECT * EXCLUDE (h), list_reduce(list_prepend({{'t': 0.0::DOUBLE, 'k': 0.0::DOUBLE, 'l': 1.0::DOUBLE}}, h),
    lambda a, b: {{'t': b.t, 'k': 0.0::DOUBLE, 'l': (1 - (1 - a.l) * exp(-(b.t - a.t) / 100.0)) * pow(0.2, b.k)}}) AS s FROM hs),
ew AS (SELECT * EXCLUDE (s), {ell_at} AS ell, CAST(s.t AS INT) AS last_t FROM fo)"""


PLAIN = fold("s.l")
END = fold("1 - (1 - s.l) * exp(-((SELECT max(t) + 1 FROM ping) - s.t) / 100.0)")


@query("evidence_weights", with_(PING, FOOT, PLAIN, select='SELECT run_id, "row", col, round(ell, 9) AS ell, last_t FROM ew'))
def _(spark, d):
    return rounded(B.evidence_weights(_obs(spark, d), PD, TAU))


@query("evidence_weights_per_agent", with_(PING, FOOT, fold("s.l", k="count(*)"), select='SELECT run_id, "row", col, round(ell, 9) AS ell, last_t FROM ew'))
def _(spark, d):
    return rounded(B.evidence_weights(_obs(spark, d, False), PD, TAU))


POST = """
jj AS (SELECT {k}, "row", col, p, p * ell AS u FROM ew JOIN cell USING ("row", col)),
zz AS (SELECT {k}, 1 - sum(p) AS bg, 1 - sum(p) + sum(u) AS z FROM jj GROUP BY ALL),
post AS (SELECT {k}, "row", col, u / z AS posterior FROM jj JOIN zz USING ({k}) UNION ALL SELECT {k}, -1, -1, bg / z FROM zz)"""


@query("posterior", with_(PING, FOOT, END, CELL, POST.format(k="run_id"), select='SELECT run_id, "row", col, round(posterior, 9) AS posterior FROM post'))
def _(spark, d):
    w = B.evidence_weights(_obs(spark, d), PD, TAU, A.pings(spark, d).agg(F.max("t") + 1).scalar())
    return rounded(B.posterior(w, A.cells(spark, d)))


TIMES = [100, 300, 600]
AT = fold('1 - (1 - s.l) * exp(-("time" - s.t) / 100.0)', 'JOIN (SELECT unnest([100, 300, 600]) AS "time") ON t <= "time"', extra='"time"')


@query("posterior_at", with_(PING, FOOT, AT, CELL, POST.format(k='run_id, "time"'), select='SELECT run_id, "time", "row", col, round(posterior, 9) AS posterior FROM post'))
def _(spark, d):
    return rounded(B.posterior_at(_obs(spark, d), A.cells(spark, d), PD, TAU, TIMES))


@query("mass_conserving_belief", with_(PING, FOOT, CELL, """
ew AS (SELECT run_id, "row", col, pow(0.2, count(DISTINCT t)) AS ell FROM foot GROUP BY ALL)""", POST.format(k="run_id"), select='SELECT run_id, "row", col, round(posterior, 9) AS posterior FROM post'))
def _(spark, d):
    return rounded(B.mass_conserving_belief(_obs(spark, d), A.cells(spark, d), PD, 0.0, _end(spark, d)))


# step by step over all touched cells; bg is the mass of the others
STEPS = """
ob AS (SELECT DISTINCT run_id, "row", col, t FROM foot),
touched AS MATERIALIZED (SELECT run_id, "row", col, p, list(t) AS ts FROM ob JOIN cell USING ("row", col) GROUP BY ALL),
rec(run_id, "row", col, p, ts, t, post, base, last, bg) USING KEY (run_id, "row", col) AS (
    SELECT run_id, "row", col, p, ts, -1, p, p, -1, 1 - sum(p) OVER (PARTITION BY run_id) FROM touched
    UNION SELECT run_id, "row", col, p, ts, t, post / s2, base, last, bg / s2 FROM (SELECT *, sum(post) OVER (PARTITION BY run_id) + bg AS s2 FROM (
        SELECT * REPLACE (CASE WHEN last >= 0 AND last < t THEN base + (p - base) * (1 - exp(-(t - last) / 100.0)) ELSE post END AS post) FROM (
            SELECT * REPLACE (post / s1 AS post, bg / s1 AS bg, CASE WHEN o THEN post / s1 ELSE base END AS base, CASE WHEN o THEN t ELSE last END AS last) FROM (
                SELECT *, sum(post) OVER (PARTITION BY run_id) + bg AS s1 FROM (
                    SELECT run_id, "row", col, p, ts, t + 1 AS t, list_contains(ts, t + 1) AS o, CASE WHEN list_contains(ts, t + 1) THEN post * 0.2 ELSE post END AS post, base, last, bg
                    FROM rec WHERE t <= (SELECT max(t) FROM ping)))))))"""


@query("mass_conserving_belief_recovering", with_(PING, FOOT, CELL, STEPS, select="""SELECT run_id, "row", col, round(post, 9) AS posterior FROM rec
    UNION ALL SELECT DISTINCT run_id, -1, -1, round(bg, 9) FROM rec""").replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    return rounded(B.mass_conserving_belief(_obs(spark, d), A.cells(spark, d), PD, TAU, _end(spark, d)))


@query("belief_stats", with_(PING, FOOT, PLAIN, CELL, """
u AS (SELECT run_id, count(DISTINCT t) AS num_updates, count(*) AS total_cells_observed FROM ob GROUP BY run_id),
m AS (SELECT run_id, count(*) AS cells_ever_observed, sum(p * (1 - ell)) AS lost FROM ew JOIN cell USING ("row", col) GROUP BY run_id)""", select="""
    SELECT run_id, num_updates, total_cells_observed, cells_ever_observed, round(1.0::DOUBLE, 9) AS prior_sum, round(1 - lost, 9) AS evidence_sum, round(1 - lost, 9) AS reduction_factor FROM u JOIN m USING (run_id)"""))
def _(spark, d):
    o = _obs(spark, d)
    return rounded(B.belief_stats(o, B.evidence_weights(o, PD, TAU), A.cells(spark, d)))


@query("grid_entropy", with_(CELL, select='SELECT grid_id, round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END), 8) AS entropy, round(max(p), 9) AS peak, count(*) FILTER (p > 0) AS support FROM cell GROUP BY grid_id'))
def _(spark, d):
    return rounded(B.grid_entropy(A.cells(spark, d), ["grid_id"]), 9, entropy=8)


TV_B = """
ewb AS (SELECT run_id, "row", col, "time", pow(0.2, len(h)) AS ell FROM hs),
jb AS (SELECT run_id, "time", "row", col, p, p * ell AS u FROM ewb JOIN cell USING ("row", col)),
zb AS (SELECT run_id, "time", 1 - sum(p) AS bg, 1 - sum(p) + sum(u) AS z FROM jb GROUP BY ALL),
pb AS (SELECT run_id, "time", "row", col, u / z AS posterior FROM jb JOIN zb USING (run_id, "time") UNION ALL SELECT run_id, "time", -1, -1, bg / z FROM zb),
tv AS (SELECT run_id, "time", 0.5 * sum(abs(coalesce(a.posterior, 0) - coalesce(b.posterior, 0))) AS tv FROM post a FULL JOIN pb b USING (run_id, "time", "row", col) GROUP BY ALL)"""


@query("total_variation", with_(PING, FOOT, AT, CELL, POST.format(k='run_id, "time"'), TV_B, select='SELECT run_id, round(arg_max(tv, "time"), 9) AS tv_last, round(max(tv), 9) AS tv_max, count(*) AS snapshots FROM tv GROUP BY run_id'))
def _(spark, d):
    o, c = _obs(spark, d), A.cells(spark, d)
    return rounded(B.total_variation(B.posterior_at(o, c, PD, TAU, TIMES), B.posterior_at(o, c, PD, 0.0, TIMES)))


SEEN = """
obs AS (SELECT DISTINCT "row", col FROM foot WHERE t < 360),
wc AS (SELECT c."row", c.col, CASE WHEN o."row" IS NOT NULL THEN p * 0.5 ELSE p END AS v FROM cell c LEFT JOIN obs o ON o."row" = c."row" AND o.col = c.col)"""


@query("position_score", with_(PING, FOOT, CELL, SEEN, select='SELECT run_id, agent_id, t, round(sum(v), 9) AS score FROM foot JOIN wc USING ("row", col) GROUP BY ALL'))
def _(spark, d):
    p, g = A.pings(spark, d), A.grid_spec(spark, d)
    return rounded(B.position_score(p, A.cells(spark, d), footprint(p.where("t < 360"), g, R), g, R, 0.5, ["run_id", "agent_id", "t"]))


@query("path_reward", with_(PING, FOOT, CELL, SEEN, select='SELECT run_id, agent_id, round(sum(v), 9) AS reward, count(*) AS cells FROM (SELECT DISTINCT run_id, agent_id, "row", col FROM foot) JOIN wc USING ("row", col) GROUP BY ALL'))
def _(spark, d):
    p, g = A.pings(spark, d), A.grid_spec(spark, d)
    return rounded(B.path_reward(p, A.cells(spark, d), footprint(p.where("t < 360"), g, R), g, R, 0.5, ["run_id", "agent_id"]))


ITEM = """
it AS (SELECT event_type || '-' || user_id AS run_id, event_type AS planning_mode, CAST(user_id AS INT) AS seed, event_id AS seq, CAST(event_id // 40 AS INT) AS replan_id,
    CAST(event_id % 4 AS INT) AS drone, k % 8 AS start_row, k % 5 AS start_col, CAST(k % 8 + event_id % 3 - 1 AS INT) AS target_row, k % 5 + k % 4 - 1 AS target_col,
    k % 3 = 0 AS action_agreement, k / 100.0 AS exact_regret, round(value * 100) / 100.0 AS exact_reward, round(value * 100) / 100.0 + k AS opt, round(value * 100) / 100.0 + k % 7 AS got
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
DEC = """
dec AS (SELECT run_id, planning_mode, seq, replan_id, drone, action_agreement, abs(got - opt) <= 1e-8 + 1e-5 * abs(opt) AS agreement_ties, opt - got AS exact_regret,
    CASE WHEN opt > 0 THEN (opt - got) / opt END AS relative_regret, opt, got FROM it)"""


@query("explode_trace", with_(ITEM, DEC, select="""SELECT run_id, seq, replan_id, drone, action_agreement, agreement_ties, round(exact_regret, 6) AS exact_regret, round(relative_regret, 6) AS relative_regret,
    round(opt, 6) AS exact_optimal_reward, round(got, 6) AS exact_bellman_action_reward FROM dec"""))
def _(spark, d):
    return rounded(TR.explode_trace(A.traces(spark, d), ["run_id"]), 6)


@query("trace_means", with_(ITEM, select="""SELECT run_id, round(avg(action_agreement::INT), 8) AS action_agreement, round(avg(exact_regret), 8) AS exact_regret, count(*) AS n_decisions, round(avg(exact_reward), 6) AS tree_exact_reward
    FROM it GROUP BY run_id"""))
def _(spark, d):
    return rounded(TR.trace_means(A.traces(spark, d), ["run_id"]), 8, tree_exact_reward=6)


@query("regret_summary", with_(ITEM, DEC, select="""SELECT planning_mode, round(avg(action_agreement::INT), 8) AS action_agreement, round(avg(agreement_ties::INT), 8) AS agreement_ties, round(avg(exact_regret), 6) AS mean_exact_regret,
    round(quantile_cont(exact_regret, 0.9), 6) AS regret_p90, round(quantile_cont(exact_regret, 0.95), 6) AS regret_p95, round(quantile_cont(exact_regret, 0.99), 6) AS regret_p99, round(max(exact_regret), 6) AS regret_max,
    round(avg(relative_regret), 6) AS mean_relative_regret, round(quantile_cont(relative_regret, 0.9), 6) AS relative_p90, round(quantile_cont(relative_regret, 0.95), 6) AS relative_p95,
    round(quantile_cont(relative_regret, 0.99), 6) AS relative_p99, count(*) AS n_decisions FROM dec GROUP BY planning_mode"""))
def _(spark, d):
    return rounded(TR.regret_summary(TR.explode_trace(A.traces(spark, d), ["planning_mode"]), ["planning_mode"]), 6, action_agreement=8, agreement_ties=8)


@query("action_disagreement", with_(ITEM, """
l AS (SELECT replan_id, drone, arg_max(target_row * 100 + target_col, seq) AS a FROM it WHERE planning_mode = 'view' GROUP BY ALL),
r AS (SELECT replan_id, drone, arg_max(target_row * 100 + target_col, seq) AS b FROM it WHERE planning_mode = 'click' GROUP BY ALL)""",
                                    select="SELECT round(avg((a <> b)::INT), 9) AS disagreement, count(*) AS comparable FROM l JOIN r USING (replan_id, drone)"))
def _(spark, d):
    i = TR.trace_items(A.traces(spark, d), ["planning_mode"])
    return rounded(TR.action_disagreement(i.where("planning_mode = 'view'"), i.where("planning_mode = 'click'")))


@query("duplicate_targets", with_(ITEM, """
t AS (SELECT planning_mode, replan_id, target_row, target_col, count(*) - 1 AS x FROM it GROUP BY ALL),
c AS (SELECT planning_mode, replan_id, sum(x) AS x FROM t GROUP BY ALL)""", select="SELECT planning_mode, CAST(sum(x) AS BIGINT) AS duplicates, round(avg((x > 0)::INT), 9) AS duplicate_cycle_fraction FROM c GROUP BY planning_mode"))
def _(spark, d):
    return rounded(TR.duplicate_targets(TR.trace_items(A.traces(spark, d), ["planning_mode"]), ["planning_mode"]))


@query("invalid_actions", with_(ITEM, CELL, """
vv AS (SELECT "row", col FROM cell WHERE valid),
cl AS (SELECT planning_mode, target_row = start_row AND target_col = start_col AS stay,
    EXISTS (SELECT 1 FROM vv WHERE abs(vv."row" - start_row) <= 1 AND abs(vv.col - start_col) <= 1 AND NOT (vv."row" = start_row AND vv.col = start_col)) AS any_nb,
    abs(target_row - start_row) <= 1 AND abs(target_col - start_col) <= 1 AND EXISTS (SELECT 1 FROM vv WHERE vv."row" = target_row AND vv.col = target_col) AS okn FROM it)""", select="""
    SELECT planning_mode, count(*) FILTER (NOT (stay AND NOT any_nb) AND NOT (NOT stay AND okn)) AS invalid, count(*) FILTER (stay AND NOT any_nb) AS holds, count(*) AS actions FROM cl GROUP BY planning_mode"""))
def _(spark, d):
    return TR.invalid_actions(TR.trace_items(A.traces(spark, d), ["planning_mode"]), A.cells(spark, d).where("valid"), ["planning_mode"])


@query("flatten_diag", """SELECT event_id, round(CAST(json_extract_string(props, '$.k') AS DOUBLE), 6) AS deadhead_total, round(CAST(json_extract_string(props, '$.k') AS DOUBLE), 6) AS deadhead_max,
    round(CAST(json_extract_string(props, '$.k') AS DOUBLE), 6) AS deadhead_mean, CAST(2 AS INT) AS survivors_count FROM events""")
def _(spark, d):
    e = A.table(spark, d, "events").withColumn("ids", F.to_json(F.array(F.col("user_id").cast("string"), F.col("event_type"))))
    return rounded(TR.flatten_diag(e, ["event_id"], {"deadhead": "props"}, {"survivors": "ids"}), 6)


@query("first_actions", with_(ITEM, select="SELECT planning_mode, drone, arg_min(target_row, seq) AS target_row, arg_min(target_col, seq) AS target_col FROM it GROUP BY ALL"))
def _(spark, d):
    return TR.first_actions(TR.trace_items(A.traces(spark, d), ["planning_mode"]), ["planning_mode"])
