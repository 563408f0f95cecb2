"""Queries over pings and the prior grid: exposure, detection, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.operators import exposure as X
from coverlens.operators import geometry as G
from coverlens.operators.grid import footprint
from coverlens.plans.ctes import CELL, CNT, FOOT, PING, STEP, with_
from coverlens.plans.registry import query, rounded
from coverlens.sources import adapters as A

R, PD, GAMMA = 1.5, 0.8, 0.999
BUDGET, FAIL = 20000.0, 5000.0


def _in(spark, d):
    return A.pings(spark, d), A.cells(spark, d), A.grid_spec(spark, d)


def _events(spark, d):
    p, _, g = _in(spark, d)
    return X.exposure_events(p, g, R)


TMAX = "(SELECT max(t) FROM ping)"
# brute force: survival of every touched cell summed over every step 0..T
RMST = """
grp AS (SELECT run_id, "row", col, t, count(*) AS k FROM foot GROUP BY ALL),
tt AS (SELECT unnest(range(0, (SELECT max(t) FROM ping) + 1)) AS s),
surv AS (SELECT c.run_id, c."row", c.col, s, pow(0.2, coalesce(sum(k), 0)) AS q FROM (SELECT DISTINCT run_id, "row", col FROM grp) c CROSS JOIN tt
    LEFT JOIN grp g ON g.run_id = c.run_id AND g."row" = c."row" AND g.col = c.col AND g.t <= s GROUP BY ALL),
cr AS (SELECT run_id, "row", col, sum(q) AS rmst FROM surv GROUP BY ALL),
rm AS (SELECT run_id, sum(p * rmst) + (1 - sum(p)) * ((SELECT max(t) FROM ping) + 1) AS "RMST" FROM cr JOIN cell USING ("row", col) GROUP BY run_id)"""
ENDPOINTS = """
ep AS (SELECT run_id, sum(p * (1 - pow(0.2, n))) AS "P_detect", sum(p) AS "L", CAST(sum(n) AS BIGINT) AS exposures, count(*) AS observed_cells,
    max(n) AS max_n, sum(n) / count(*) AS exposure_multiplicity, (sum(n) - count(*)) / sum(n) AS revisit_fraction
    FROM cnt JOIN cell USING ("row", col) GROUP BY run_id)"""


@query("footprint", with_(PING, FOOT, select='SELECT run_id, agent_id, t, "row", col FROM foot'))
def _(spark, d):
    p, _, g = _in(spark, d)
    return footprint(p, g, R).select("run_id", "agent_id", "t", "row", "col")


@query("exposure_events", with_(PING, FOOT, select='SELECT run_id, agent_id, "row", col, t FROM foot'))
def _(spark, d):
    return _events(spark, d)


@query("exposure_counts", with_(PING, FOOT, CNT, select='SELECT run_id, "row", col, n FROM cnt'))
def _(spark, d):
    return X.exposure_counts(_events(spark, d))


@query("expected_detection", with_(PING, FOOT, CNT, CELL, ENDPOINTS, select='SELECT run_id, round("P_detect", 9) AS "P_detect" FROM ep'))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.expected_detection(X.exposure_counts(X.exposure_events(p, g, R)), c, PD, p))


@query("expected_rmst", with_(PING, FOOT, CELL, RMST, select='SELECT run_id, round("RMST", 6) AS "RMST" FROM rm'))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.expected_rmst(X.exposure_events(p, g, R), c, PD, p.agg(F.max("t")).scalar(), p), 6)


@query("coverage", with_(PING, FOOT, CNT, CELL, ENDPOINTS, select='SELECT run_id, round("L", 9) AS "L", observed_cells FROM ep'))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.coverage(X.exposure_events(p, g, R), c, p))


@query("exposure_stats", with_(PING, FOOT, CNT, CELL, select="""SELECT run_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS observed_cells, max(n) AS max_n,
    round((sum(n) - count(*)) / sum(n), 9) AS revisit_fraction, round(sum(n) / count(*), 9) AS exposure_multiplicity,
    round(count(*) / (SELECT count(*) FROM cell WHERE valid), 9) AS new_coverage_fraction FROM cnt GROUP BY run_id"""))
def _(spark, d):
    p, c, g = _in(spark, d)
    n_valid = c.agg(F.count_if("valid")).scalar()
    return rounded(X.exposure_stats(X.exposure_counts(X.exposure_events(p, g, R)), n_valid, p))


EP_SELECT = """SELECT run_id, round("P_detect", 9) AS "P_detect", round("RMST", 6) AS "RMST", round("L", 9) AS "L", exposures, observed_cells, max_n,
    round(exposure_multiplicity, 9) AS exposure_multiplicity, round(revisit_fraction, 9) AS revisit_fraction FROM ep JOIN rm USING (run_id)"""


@query("mission_endpoints", with_(PING, FOOT, CNT, CELL, ENDPOINTS, RMST, select=EP_SELECT))
def mission_endpoints(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.mission_endpoints(p, c, g, R, PD), 9, RMST=6)


PING_300 = PING.replace("ping AS (", "ping_all AS (") + ", ping AS (SELECT * FROM ping_all WHERE t <= 300)"


@query("mission_endpoints_tref", with_(PING_300, FOOT, CNT, CELL, ENDPOINTS, RMST.replace("(SELECT max(t) FROM ping)", "300"), select=EP_SELECT))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.mission_endpoints(p, c, g, R, PD, t_max=300), 9, RMST=6)


RES = """
tot AS (SELECT run_id, agent_id, max(cum) AS total, CAST(ceil(max(cum) / 25.0) AS INT) AS n FROM cum GROUP BY ALL),
seg AS (SELECT *, lag(cum, 1, -1.0) OVER (PARTITION BY run_id, agent_id ORDER BY t) AS pc FROM cum),
smp0 AS (SELECT run_id, agent_id, total, n, unnest(range(0, n + 1)) AS i FROM tot WHERE total > 0),
smp AS (SELECT s.run_id, s.agent_id, CAST(i AS INT) AS i, total * i / n AS distance,
    CASE WHEN step > 0 THEN px + (total * i / n - pc) / step * (x - px) ELSE x END AS x, CASE WHEN step > 0 THEN py + (total * i / n - pc) / step * (y - py) ELSE y END AS y
    FROM smp0 s JOIN seg g ON s.run_id = g.run_id AND s.agent_id = g.agent_id AND total * i / n > pc AND total * i / n <= cum)"""


@query("with_distance", with_(PING, STEP, select="SELECT run_id, agent_id, t, round(step, 6) AS step, round(cum, 6) AS cum FROM cum"))
def _(spark, d):
    return rounded(G.with_distance(A.pings(spark, d)).select("run_id", "agent_id", "t", "step", "cum"), 6)


@query("route_length", with_(PING, STEP, select="SELECT run_id, agent_id, round(sum(step), 6) AS length FROM st GROUP BY ALL"))
def _(spark, d):
    return rounded(G.route_length(A.pings(spark, d)), 6)


@query("max_step", with_(PING, STEP, select="SELECT run_id, round(max(step), 6) AS max_step FROM st GROUP BY ALL"))
def _(spark, d):
    return rounded(G.max_step(A.pings(spark, d), ["run_id"]), 6)


@query("no_repeats", with_(PING, STEP, select="SELECT run_id, agent_id, bool_and(px IS NULL OR NOT (x = px AND y = py)) AS no_repeats FROM st GROUP BY ALL"))
def _(spark, d):
    return G.no_repeats(A.pings(spark, d), G.PATH)


@query("resample_path", with_(PING, STEP, RES, select="SELECT run_id, agent_id, i, round(distance, 5) AS distance, round(x, 5) AS x, round(y, 5) AS y FROM smp"))
def _(spark, d):
    return rounded(G.resample_path(A.pings(spark, d), 25.0), 5)


@query("split_path", with_(PING, STEP, """
tot AS (SELECT run_id, agent_id, max(cum) AS total FROM cum GROUP BY ALL)""", select="""
    SELECT run_id, agent_id, CAST(part AS INT) AS part, count(*) AS pieces, round(sum(least(cum, total * (part + 1) / 3) - greatest(cum - step, total * part / 3)), 5) AS length
    FROM cum JOIN tot USING (run_id, agent_id), range(0, 3) r(part)
    WHERE step > 0 AND least(cum, total * (part + 1) / 3) > greatest(cum - step, total * part / 3) + 1e-9 GROUP BY ALL"""))
def _(spark, d):
    s = G.split_path(A.pings(spark, d), 3).where("length > 1e-9")
    return rounded(s.groupBy("run_id", "agent_id", "part").agg(F.count("*").alias("pieces"), F.sum("length").alias("length")), 5)


@query("split_route", with_(PING, STEP, """
tot AS (SELECT run_id, agent_id, max(cum) AS total, min(t) AS lo, max(t) AS hi FROM cum GROUP BY ALL),
c AS (SELECT run_id, agent_id, k, arg_min(t, {'g': abs(cum - total * k / 3), 't': t}) AS b FROM cum JOIN tot USING (run_id, agent_id), range(1, 3) r(k) WHERE total > 0 GROUP BY ALL),
b AS (SELECT run_id, agent_id, b FROM c UNION SELECT run_id, agent_id, lo FROM tot UNION SELECT run_id, agent_id, hi FROM tot),
s AS (SELECT run_id, agent_id, CAST(row_number() OVER w - 1 AS INT) AS part, b AS start_t, lead(b) OVER w AS end_t FROM b WINDOW w AS (PARTITION BY run_id, agent_id ORDER BY b))""",
                            select="SELECT * FROM s WHERE end_t IS NOT NULL"))
def _(spark, d):
    return G.split_path(A.pings(spark, d), 3, exact=False)


@query("truncate_path", with_(PING, STEP, select="""SELECT run_id, agent_id, t,
    round(CASE WHEN cum > 500 THEN px + (500 - (cum - step)) / step * (x - px) ELSE x END, 5) AS x,
    round(CASE WHEN cum > 500 THEN py + (500 - (cum - step)) / step * (y - py) ELSE y END, 5) AS y, round(least(cum, 500.0), 5) AS cum
    FROM cum WHERE cum <= 500 OR (cum - step < 500 AND step > 0)"""))
def _(spark, d):
    return rounded(G.truncate_path(A.pings(spark, d), 500.0), 5)


@query("trim_ends", with_(PING, """
u AS (SELECT *, min(t) FILTER (x < 32) OVER w AS f, max(t) FILTER (x < 32) OVER w AS l FROM ping WINDOW w AS (PARTITION BY run_id, agent_id)),
c AS (SELECT run_id, agent_id, count(*) FILTER (t < f) AS prefix_removed, count(*) FILTER (t > l) AS suffix_removed FROM u GROUP BY ALL)""",
                          select="SELECT run_id, agent_id, t, x, y, prefix_removed, suffix_removed FROM u JOIN c USING (run_id, agent_id) WHERE t BETWEEN f AND l"))
def _(spark, d):
    return G.trim_ends(A.pings(spark, d), F.col("x") < 32)


@query("has_unseen", with_(PING, FOOT, CELL, """
obs AS (SELECT DISTINCT "row", col FROM foot WHERE t < 360),
live AS (SELECT "row", col FROM cell WHERE valid AND ("row", col) NOT IN (SELECT ("row", col) FROM obs)),
hit AS (SELECT DISTINCT run_id, agent_id, t FROM foot JOIN live USING ("row", col))""", select="""
    SELECT run_id, agent_id, t, h.t IS NOT NULL AS has_unseen FROM ping p LEFT JOIN hit h USING (run_id, agent_id, t)""").replace("h.t IS NOT NULL", "(run_id, agent_id, t) IN (SELECT (run_id, agent_id, t) FROM hit)").replace(" p LEFT JOIN hit h USING (run_id, agent_id, t)", ""))
def _(spark, d):
    p, c, g = _in(spark, d)
    obs = footprint(p.where("t < 360"), g, R)
    return G.has_unseen(p, c, obs, g, R, ["run_id", "agent_id", "t"])


@query("entry_cost", with_(PING, """
last AS (SELECT run_id, agent_id, arg_max(x, t) AS x, arg_max(y, t) AS y FROM ping GROUP BY ALL),
task AS (SELECT run_id, t // 240 AS task_id, arg_min(x, (t, agent_id)) AS x0, arg_min(y, (t, agent_id)) AS y0, arg_max(x, (t, agent_id)) AS x1, arg_max(y, (t, agent_id)) AS y1 FROM ping GROUP BY ALL),
j AS (SELECT run_id, agent_id, task_id, sqrt((x0 - x) * (x0 - x) + (y0 - y) * (y0 - y)) AS f, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS r FROM last JOIN task USING (run_id))""",
                           select="""SELECT run_id, agent_id, CAST(task_id AS BIGINT) AS task_id, round(least(f, r), 6) AS cost, CASE WHEN f <= r THEN 'forward' ELSE 'reverse' END AS orientation FROM j"""))
def _(spark, d):
    p = A.pings(spark, d)
    last = p.groupBy("run_id", "agent_id").agg(F.max_by(F.struct("x", "y"), "t").alias("e")).select("run_id", "agent_id", "e.x", "e.y")
    o = F.struct("t", "agent_id")
    tasks = p.groupBy("run_id", F.floor(F.col("t") / 240).alias("task_id")).agg(F.min_by(F.struct("x", "y"), o).alias("a"), F.max_by(F.struct("x", "y"), o).alias("b"))
    tasks = tasks.select("run_id", "task_id", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))
    return rounded(G.entry_cost(last, tasks), 6)


@query("discounted_score", with_(PING, STEP, RES, """
ln AS (SELECT run_id, agent_id, sum(step) AS length FROM st GROUP BY ALL),
off AS (SELECT run_id, agent_id, sum(length) OVER (PARTITION BY run_id ORDER BY agent_id ROWS UNBOUNDED PRECEDING) - length AS o FROM ln),
keep AS (SELECT * FROM smp)""", FOOT.replace("FROM ping p", "FROM keep p"), CELL, select="""
    SELECT run_id, round(sum(p * pow(0.9999, distance + o)), 6) AS discounted_score FROM foot JOIN off USING (run_id, agent_id) JOIN cell USING ("row", col) GROUP BY run_id"""))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.discounted_score(G.resample_path(p, 25.0), c, g, R, 0.9999, G.route_length(p)), 6)


CUMCOV = """
fs AS (SELECT run_id, agent_id, "row", col, min(t) AS t FROM foot GROUP BY ALL),
ms AS (SELECT run_id, agent_id, t, sum(p) AS m FROM fs JOIN cell USING ("row", col) GROUP BY ALL),
cc AS (SELECT run_id, agent_id, t, cum, sum(coalesce(m, 0)) OVER w AS likelihood, sum(coalesce(m, 0) * pow(0.999, cum)) OVER w AS discounted
    FROM cum LEFT JOIN ms USING (run_id, agent_id, t) WINDOW w AS (PARTITION BY run_id, agent_id ORDER BY t ROWS UNBOUNDED PRECEDING))"""


@query("cumulative_coverage", with_(PING, STEP, FOOT, CELL, CUMCOV, select="SELECT run_id, agent_id, t, round(cum, 6) AS cum, round(likelihood, 9) AS likelihood, round(discounted, 9) AS discounted FROM cc"))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.cumulative_coverage(p, c, g, R, GAMMA), 9, cum=6)


@query("agent_time_series", with_(PING, STEP, FOOT, CELL, CUMCOV, select="""SELECT run_id, agent_id, t, x, y, round(cum, 6) AS cum, round(likelihood, 9) AS likelihood, round(discounted, 9) AS discounted
    FROM cc JOIN ping USING (run_id, agent_id, t)"""))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.agent_time_series(p, c, g, R, GAMMA), 9, cum=6)


@query("path_length_km", with_(PING, STEP, select="SELECT run_id, round(sum(step) / 1000.0, 6) AS length_km FROM st GROUP BY ALL"))
def _(spark, d):
    return rounded(X.path_length_km(A.pings(spark, d)), 6)


@query("area_covered", with_(PING, FOOT, CNT, select="SELECT run_id, round(count(*) / 1000000.0, 9) AS area_km2 FROM cnt GROUP BY run_id"))
def _(spark, d):
    p, _, g = _in(spark, d)
    return rounded(X.area_covered(X.exposure_events(p, g, R), g))


TARGETS = """
tg AS (SELECT CAST(c_custkey AS INT) AS target_id, CAST(c_custkey % 64 AS DOUBLE) AS x, round(c_acctbal * 100) / 2000.0 AS y FROM customer)"""
FOUND = """
found AS (SELECT DISTINCT s.run_id, g.target_id FROM st s JOIN tg g ON g.y BETWEEN least(s.y, py) - 1.5 AND greatest(s.y, py) + 1.5 AND g.x BETWEEN least(s.x, px) - 1.5 AND greatest(s.x, px) + 1.5
    WHERE px IS NOT NULL AND step > 0 AND sqrt(pow(g.x - (px + greatest(0.0, least(1.0, ((g.x - px) * (s.x - px) + (g.y - py) * (s.y - py)) / ((s.x - px) * (s.x - px) + (s.y - py) * (s.y - py)))) * (s.x - px)), 2)
      + pow(g.y - (py + greatest(0.0, least(1.0, ((g.x - px) * (s.x - px) + (g.y - py) * (s.y - py)) / ((s.x - px) * (s.x - px) + (s.y - py) * (s.y - py)))) * (s.y - py)), 2)) <= 1.5)"""


def _targets(spark, d):
    c = A.table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("int").alias("target_id"), (F.col("c_custkey") % 64).cast("double").alias("x"), (F.round(F.col("c_acctbal") * 100) / 2000.0).alias("y"))


@query("targets_found", with_(PING, STEP, TARGETS, FOUND, select="SELECT run_id, target_id FROM found"))
def _(spark, d):
    return X.targets_found(A.pings(spark, d), _targets(spark, d), R)


@query("targets_found_pct", with_(PING, STEP, TARGETS, FOUND, select="SELECT run_id, count(target_id) AS found, round(count(target_id) * 100.0 / (SELECT count(*) FROM tg), 6) AS percentage_found FROM (SELECT DISTINCT run_id FROM ping) LEFT JOIN found USING (run_id) GROUP BY run_id"))
def _(spark, d):
    p, t = A.pings(spark, d), _targets(spark, d)
    return rounded(X.found_percentage(X.targets_found(p, t, R), t, p), 6)


@query("view_score", with_(PING, FOOT, CELL, """
vis AS (SELECT DISTINCT "row", col FROM foot WHERE t < 360),
f AS (SELECT run_id, agent_id, t, sum(p) AS s FROM foot JOIN cell USING ("row", col) ANTI JOIN vis USING ("row", col) GROUP BY ALL)""", select="""
    SELECT run_id, agent_id, t, round(coalesce(s, 0.0), 9) AS view_score FROM ping LEFT JOIN f USING (run_id, agent_id, t)"""))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.view_score(p, c, footprint(p.where("t < 360"), g, R), g, R, ["run_id", "agent_id", "t"]))


@query("metrics_by_distance", with_(PING, STEP, FOOT.replace("FROM ping p", "FROM cum p"), CELL, """
fs AS (SELECT run_id, "row", col, min(cum) AS at FROM foot GROUP BY ALL),
n AS (SELECT run_id, unnest(range(0, CAST(ceil(max(cum) / 100.0) AS INT) + 1)) AS i FROM cum GROUP BY run_id)""", select="""
    SELECT n.run_id, CAST(i AS INT) AS interval, round(coalesce(sum(p), 0), 9) AS likelihood, count(p) AS cells, round(i * 100.0, 6) AS distance, round(count(p) / 1000000.0, 9) AS area_km2
    FROM n LEFT JOIN (fs JOIN cell USING ("row", col)) f ON f.run_id = n.run_id AND CAST(ceil(f.at / 100.0) AS INT) <= i GROUP BY n.run_id, i"""))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.metrics_by_distance(p, c, g, R, 100.0))


@query("metrics_by_index", with_(PING, STEP, """
ix AS (SELECT *, row_number() OVER (PARTITION BY run_id, agent_id ORDER BY t) - 1 AS idx FROM cum)""", FOOT.replace("FROM ping p", "FROM ix p"), CELL, """
fs AS (SELECT run_id, "row", col, min(idx) AS at FROM foot GROUP BY ALL),
n AS (SELECT run_id, unnest(range(0, CAST(ceil(max(idx) / 5.0) AS INT) + 1)) AS i FROM ix GROUP BY run_id),
dd AS (SELECT n.run_id, n.i, avg(m) AS mean_distance FROM n JOIN (SELECT n2.run_id, n2.i, agent_id, max(cum) AS m FROM n n2 JOIN ix ON ix.run_id = n2.run_id AND idx <= n2.i * 5 GROUP BY ALL) q
    ON q.run_id = n.run_id AND q.i = n.i GROUP BY ALL),
ll AS (SELECT n.run_id, i, coalesce(sum(p), 0) AS likelihood, count(p) AS cells FROM n LEFT JOIN (fs JOIN cell USING ("row", col)) f ON f.run_id = n.run_id AND f.at <= i * 5 GROUP BY ALL)""",
                                 select="SELECT run_id, CAST(i AS INT) AS interval, round(likelihood, 9) AS likelihood, cells, round(mean_distance, 5) AS mean_distance FROM ll JOIN dd USING (run_id, i)"))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.metrics_by_index(p, c, g, R, 5), 9, mean_distance=5)


CROSS = """
fd AS (SELECT run_id, t, sum(sum(step)) OVER (PARTITION BY run_id ORDER BY t) AS distance FROM st GROUP BY run_id, t),
cr0 AS (SELECT run_id, min(t) AS trigger_step, arg_min(distance, t) AS failure_distance FROM fd WHERE distance >= 5000 GROUP BY run_id)"""


@query("first_crossing", with_(PING, STEP, CROSS, select="SELECT run_id, trigger_step, round(failure_distance, 5) AS failure_distance FROM cr0"))
def _(spark, d):
    return rounded(X.first_crossing(A.pings(spark, d), FAIL), 5)


@query("recovery_curve", with_(PING, STEP, FOOT, CELL, CROSS, """
lst AS (SELECT run_id, max(t) AS last FROM ping GROUP BY run_id),
gr AS (SELECT DISTINCT run_id, last, CAST(s AS INT) AS step FROM (SELECT run_id, last, unnest(list_append(range(0, last + 1, 24), last)) AS s FROM lst)),
ex AS (SELECT g.run_id, g.step, f."row", f.col, count(*) AS n FROM gr g JOIN foot f ON f.run_id = g.run_id AND f.t <= g.step GROUP BY ALL),
pl AS (SELECT run_id, step, sum(p * (1 - pow(0.2, n))) AS pc, sum(p) AS lc FROM ex JOIN cell USING ("row", col) GROUP BY ALL),
da AS (SELECT g.run_id, g.step, coalesce(max(distance), 0) AS da FROM gr g LEFT JOIN fd ON fd.run_id = g.run_id AND fd.t <= g.step GROUP BY ALL)""", select="""
    SELECT run_id, step, round(da, 4) AS distance_absolute, round(greatest(0.0, da - failure_distance), 4) AS distance_post_fault,
    round(greatest(0.0, da - failure_distance) / (CASE WHEN 2000000 - failure_distance > 1e-9 THEN 2000000 - failure_distance END), 8) AS b_post,
    round(coalesce(pc, 0), 9) AS "P_detect_cumulative", round(coalesce(lc, 0), 9) AS "L_cumulative" FROM da LEFT JOIN pl USING (run_id, step) LEFT JOIN cr0 USING (run_id)"""))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.recovery_curve(p, c, g, R, PD, 24, X.first_crossing(p, FAIL), 2_000_000.0), 9, distance_absolute=4, distance_post_fault=4, b_post=8)


@query("pre_post_endpoints", with_(PING, STEP, FOOT, CELL, CROSS, """
c AS (SELECT run_id, "row", col, count(*) AS n, count(*) FILTER (t <= trigger_step OR trigger_step IS NULL) AS n_pre FROM foot LEFT JOIN cr0 USING (run_id) GROUP BY ALL),
z AS (SELECT run_id, sum(p * (1 - pow(0.2, n_pre))) AS a, sum(p * (1 - pow(0.2, n))) AS b, CAST(sum(n - n_pre) AS BIGINT) AS post_exposures FROM c JOIN cell USING ("row", col) GROUP BY run_id)""",
                                   select="""SELECT run_id, round(a, 9) AS "Pdet_at_fault", round(b, 9) AS "P_detect", round(b - a, 9) AS "PostFault_PdetGain",
    round(CASE WHEN 1 - a > 1e-12 THEN (b - a) / (1 - a) END, 9) AS "ConditionalPostFaultPdet", post_exposures FROM z"""))
def _(spark, d):
    p, c, g = _in(spark, d)
    return rounded(X.pre_post_endpoints(p, c, g, R, PD, X.first_crossing(p, FAIL)))


MOVING = """
tk AS (SELECT CAST(event_id % 4 AS INT) AS target_id, t, arg_max(x, event_id) AS tx, arg_max(y, event_id) AS ty FROM e0 GROUP BY ALL),
h AS (SELECT run_id, target_id, p.t, count(*) AS k, bool_or(('0x' || substr(md5('7|' || run_id || '|' || target_id || '|' || agent_id || '|' || p.t), 1, 13))::BIGINT / 4503599627370496.0 < 0.8) AS lucky
    FROM ping p JOIN tk ON tk.t = p.t WHERE sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) <= 20 GROUP BY ALL),
pairs AS (SELECT DISTINCT run_id, target_id FROM h),
sv AS (SELECT q.run_id, q.target_id, s, pow(0.2, coalesce(sum(k), 0)) AS sv FROM pairs q CROSS JOIN (SELECT unnest(range(0, (SELECT max(t) FROM ping) + 1)) AS s) LEFT JOIN h ON h.run_id = q.run_id AND h.target_id = q.target_id AND h.t <= s GROUP BY ALL),
a AS (SELECT run_id, target_id, 1 - min(sv) AS "P_detect", sum(sv) AS "RMST" FROM sv GROUP BY ALL),
b AS (SELECT run_id, target_id, CAST(sum(k) AS BIGINT) AS exposures, coalesce(min(t) FILTER (lucky), (SELECT max(t) FROM ping) + 1) AS "T_detect_realized", bool_or(lucky) AS detected FROM h GROUP BY ALL)"""


@query("moving_target_detection", with_(PING, MOVING, select="""SELECT run_id, target_id, coalesce(exposures, 0) AS exposures, round(coalesce("P_detect", 0), 9) AS "P_detect", round(coalesce("RMST", tt), 6) AS "RMST", coalesce("T_detect_realized", tt) AS "T_detect_realized", coalesce(detected, false) AS detected
    FROM (SELECT DISTINCT run_id, CAST(event_id % 7 AS INT) AS target_id, (SELECT max(t) FROM ping) + 1 AS tt FROM e0) LEFT JOIN a USING (run_id, target_id) LEFT JOIN b USING (run_id, target_id)"""))
def _(spark, d):
    p = A.pings(spark, d)
    pairs = A.table(spark, d, "events").select(F.col("event_type").alias("run_id"), (F.col("event_id") % 7).cast("int").alias("target_id"))
    return rounded(X.moving_target_detection(p, A.tracks(spark, d), 20.0, PD, p.agg(F.max("t")).scalar(), seed=7, pairs=pairs), 9, RMST=6)


TTD = """
smp AS (SELECT CAST(c_custkey AS INT) AS sample_id, CAST(c_custkey % (SELECT n_rows FROM spec) AS INT) AS "row", CAST(c_custkey % 64 AS INT) AS col FROM customer),
grp AS (SELECT run_id, "row", col, t, count(*) AS k FROM foot GROUP BY ALL),
hit AS (SELECT run_id, sample_id, min(t) AS ttd FROM grp JOIN smp USING ("row", col)
    WHERE ('0x' || substr(md5('11|' || run_id || '|' || sample_id || '|' || t), 1, 13))::BIGINT / 4503599627370496.0 < 1 - pow(0.2, k) GROUP BY ALL),
g AS (SELECT run_id, count(*) AS hits, sum(ttd) AS tt FROM hit GROUP BY run_id)"""


def _ttd_samples(spark, d):
    c = A.table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("int").alias("sample_id"), (F.col("c_custkey") % A.grid_spec(spark, d).rows).cast("int").alias("row"), (F.col("c_custkey") % 64).cast("int").alias("col"))


@query("realized_ttd", with_(PING, FOOT, TTD, select="""SELECT run_id, (SELECT count(*) FROM smp) AS samples, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / (SELECT count(*) FROM smp), 9) AS "mc_P",
    round((coalesce(tt, 0) + ((SELECT count(*) FROM smp) - coalesce(hits, 0)) * ((SELECT max(t) FROM ping) + 1)) / (SELECT count(*) FROM smp), 6) AS "mc_RMST"
    FROM (SELECT DISTINCT run_id FROM foot) LEFT JOIN g USING (run_id)"""))
def _(spark, d):
    p, _, g = _in(spark, d)
    return rounded(X.realized_ttd(X.exposure_events(p, g, R), _ttd_samples(spark, d), PD, p.agg(F.max("t")).scalar(), 11), 9, mc_RMST=6)


AGENT = """
ac AS (SELECT run_id, agent_id, sum(p) AS likelihood FROM (SELECT DISTINCT run_id, agent_id, "row", col FROM foot) JOIN cell USING ("row", col) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY likelihood DESC) AS rn FROM ac),
dk AS (SELECT run_id, k, sum(likelihood) AS total, count(*) AS m, sum(likelihood) FILTER (rn <= k) AS wk FROM rk, range(1, 4) r(k) GROUP BY ALL)"""
DK = """SELECT run_id, CAST(k AS INT) AS k, round(total, 9) AS baseline_likelihood, round(total - wk, 9) AS worst_lh, round(100 * wk / total, 7) AS worst_pct,
    round(total - k * total / m, 9) AS avg_lh, round(100 * k * (total / m) / total, 7) AS avg_pct FROM dk"""


def agent_coverage(spark, d):
    p, c, g = _in(spark, d)
    seen = footprint(p, g, R).select("run_id", "agent_id", "row", "col").distinct()
    return seen.join(c.select("row", "col", "p"), ["row", "col"]).groupBy("run_id", "agent_id").agg(F.sum("p").alias("likelihood"))


def drop_k(spark, d):
    ac = agent_coverage(spark, d)
    return X.drop_k_loss(ac, 1).unionByName(X.drop_k_loss(ac, 2)).unionByName(X.drop_k_loss(ac, 3))


@query("drop_k_loss", with_(PING, FOOT, CELL, AGENT, select=DK))
def _(spark, d):
    return rounded(drop_k(spark, d), 9, worst_pct=7, avg_pct=7)


@query("resilience_summary", with_(PING, FOOT, CELL, AGENT, select="""SELECT CAST(k AS INT) AS k, round(avg(100 * wk / total), 7) AS mean_worst_pct, round(stddev_samp(100 * wk / total), 7) AS std_worst_pct,
    round(avg(100 * k / m), 7) AS mean_avg_pct, count(*) AS n FROM dk GROUP BY k"""))
def _(spark, d):
    return rounded(drop_k(spark, d).groupBy("k").agg(F.avg("worst_pct").alias("mean_worst_pct"), F.stddev_samp("worst_pct").alias("std_worst_pct"),
                                                     F.avg("avg_pct").alias("mean_avg_pct"), F.count("*").alias("n")), 7)


@query("termination", with_(PING, STEP, select="""SELECT run_id, agent_id, CASE WHEN cum >= 2000 - 1e-9 * 2000 THEN 'budget_exhausted' WHEN cum >= 1500 - 1e-9 THEN 'path_exhausted' ELSE 'completed' END AS termination_reason,
    round(cum / 2000.0, 8) AS budget_utilization FROM (SELECT run_id, agent_id, max(cum) AS cum FROM cum GROUP BY ALL)"""))
def _(spark, d):
    r = G.route_length(A.pings(spark, d)).select("run_id", "agent_id", F.col("length").alias("distance"), F.col("length").alias("progress"), F.lit(1500.0).alias("path_length"))
    return rounded(X.termination(r, 2000.0).select("run_id", "agent_id", "termination_reason", "budget_utilization"), 8)


@query("mc_validation", with_(PING, FOOT, CNT, CELL, TTD, """
smc AS (SELECT s.sample_id, s."row", s.col FROM smp s),
pr AS (SELECT run_id, avg(1 - pow(0.2, coalesce(n, 0))) AS ex FROM (SELECT DISTINCT run_id FROM foot) CROSS JOIN smc LEFT JOIN cnt USING (run_id, "row", col) GROUP BY run_id),
mc AS (SELECT run_id, coalesce(hits, 0) / (SELECT count(*) FROM smp) AS mc FROM (SELECT DISTINCT run_id FROM foot) LEFT JOIN g USING (run_id))""", select="""
    SELECT run_id, round(ex, 9) AS exact, round(mc, 9) AS mc_mean, round(abs(mc - ex), 9) AS abs_error, round(3 * sqrt(0.25 / (SELECT count(*) FROM smp)), 9) AS allowed_3sigma,
    abs(mc - ex) <= 3 * sqrt(0.25 / (SELECT count(*) FROM smp)) AS within FROM pr JOIN mc USING (run_id)"""))
def _(spark, d):
    p, _, g = _in(spark, d)
    ev = X.exposure_events(p, g, R)
    smp = _ttd_samples(spark, d)
    n = smp.agg(F.count("*")).scalar()
    hit = X.exposure_counts(ev).join(smp, ["row", "col"]).groupBy("run_id").agg((F.sum(1.0 - F.pow(F.lit(1 - PD), F.col("n"))) / n).alias("exact"))
    mc = X.realized_ttd(ev, smp, PD, p.agg(F.max("t")).scalar(), 11).select("run_id", F.col("mc_P").alias("mc_mean"))
    j = mc.join(hit, "run_id", "left").withColumn("exact", F.coalesce("exact", F.lit(0.0)))
    err, tol = F.abs(F.col("mc_mean") - F.col("exact")), 3 * F.sqrt(0.25 / n)
    return rounded(j.select("run_id", "exact", "mc_mean", err.alias("abs_error"), tol.alias("allowed_3sigma"), (err <= tol).alias("within")))
