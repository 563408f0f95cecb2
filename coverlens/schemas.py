"""Declared schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

PING = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("agent_id", T.IntegerType()),
    T.StructField("t", T.IntegerType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])

STREAM_PING = T.StructType([T.StructField("event_id", T.LongType()), *PING.fields, T.StructField("ts", T.TimestampType())])

TRACE_ITEM = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("replan_id", T.IntegerType()),
    T.StructField("drone", T.IntegerType()),
    T.StructField("start_row", T.IntegerType()),
    T.StructField("start_col", T.IntegerType()),
    T.StructField("target_row", T.IntegerType()),
    T.StructField("target_col", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("action_agreement", T.BooleanType()),
    T.StructField("exact_regret", T.DoubleType()),
    T.StructField("exact_reward", T.DoubleType()),
    T.StructField("exact_optimal_reward", T.DoubleType()),
    T.StructField("exact_bellman_action_reward", T.DoubleType()),
])
