"""Streaming queries, drained with availableNow; the SQL twins are the batch definitions over closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.plans.belief import PD, PLAIN, R, TAU
from coverlens.plans.ctes import CELL, FOOT, STREAM_PING, STREAM_STEP, with_
from coverlens.plans.exposure import CROSS
from coverlens.plans.registry import query, rounded
from coverlens.sources import adapters as A
from coverlens.streaming import pings as S

# a window, or a step, is out once the watermark (last event less the delay of one hour) has passed its end
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
DONE = STREAM_PING.replace("USING (event_id))", f"USING (event_id) WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED})")


def _pings(spark, d):
    return S.stream_pings(A.ping_stream(spark, d))


@query("stream_pings", with_(STREAM_PING, select="SELECT run_id, agent_id, t, x, y, event_id FROM ping"))
def _(spark, d):
    return S.run_to_table(_pings(spark, d).select("run_id", "agent_id", "t", "x", "y", "event_id"), "pings")


# all pings so far, also those of windows that are still open; a ping without a time is in no window
@query("stream_exposure", with_(STREAM_PING, FOOT, select='SELECT run_id, "row", col, count(*) AS n FROM foot WHERE ts IS NOT NULL GROUP BY ALL'))
def _(spark, d):
    return S.exposure_totals(_pings(spark, d), A.grid_spec(spark, d), R, "exposure")


@query("stream_coverage", with_(STREAM_PING, FOOT, CELL, select=f"""SELECT w AS window_start, run_id, round(sum(p), 9) AS "L", count(*) AS cells FROM (SELECT DISTINCT date_trunc('day', ts) AS w, run_id, "row", col FROM foot) JOIN cell USING ("row", col) WHERE w + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL"""))
def _(spark, d):
    t = S.run_to_table(S.stream_coverage(_pings(spark, d), A.cells(spark, d), A.grid_spec(spark, d), R, "1 day"), "coverage")
    return rounded(t.select(F.to_timestamp_ntz(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).alias("window_start"), "run_id", "L", "cells"))


@query("stream_evidence", with_(DONE, FOOT, PLAIN, select='SELECT run_id, "row", col, round(ell, 9) AS ell, last_t FROM ew'))
def _(spark, d):
    t = S.run_to_table(S.stream_evidence(_pings(spark, d), A.grid_spec(spark, d), R, PD, TAU), "evidence")
    last = t.groupBy("run_id", "row", "col").agg(F.max_by(F.struct("ell", "last_t"), "last_t").alias("s"))
    return rounded(last.select("run_id", "row", "col", "s.*"))


@query("stream_crossing", with_(DONE, STREAM_STEP, CROSS, select="SELECT run_id, trigger_step, round(failure_distance, 5) AS failure_distance FROM cr0"))
def _(spark, d):
    return rounded(S.run_to_table(S.stream_crossing(_pings(spark, d), 5000.0), "crossing"), 5)


@query("stream_step_bound", with_(DONE, STREAM_STEP, select="SELECT run_id, agent_id, t, event_id, round(step, 6) AS step, CAST(dt AS INT) AS dt FROM st WHERE dt IS NOT NULL AND step > 5.0 * greatest(dt, 1)"))
def _(spark, d):
    return rounded(S.run_to_table(S.stream_step_bound(_pings(spark, d), 5.0).withColumn("agent_id", F.col("agent_id").cast("int")), "bound"), 6)


@query("stream_sessions", with_(STREAM_PING, """
s1 AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM ping WINDOW w AS (PARTITION BY run_id, agent_id ORDER BY ts)),
s2 AS (SELECT *, sum(b) OVER (PARTITION BY run_id, agent_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s1)""", select=f"""
    SELECT run_id, agent_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS pings FROM s2 GROUP BY run_id, agent_id, g HAVING max(ts) + INTERVAL 2 DAY <= {CLOSED}"""))
def _(spark, d):
    t = S.run_to_table(S.stream_sessions(_pings(spark, d), "2 days"), "sessions")
    return t.select("run_id", "agent_id", F.unix_micros("session_start").alias("start_us"), "pings")
