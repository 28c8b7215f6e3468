"""Trace views over the driver tables, and the SQL text of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktraces.operators.sequence import attach, number_rows, summarise
from sparktraces.plans.registry import table

KEYS = ["trace_id"]


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as traces: one trace per user, a frame per event, time in hours since its first event."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"),
        "event_id",
        F.col("event_type").alias("channel"),
        F.col("value").alias("y"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"),
    )
    numbered = number_rows(events, KEYS, ["us", "event_id"], "us", n_rows="n_rows", start="us0")
    return numbered.select(
        "trace_id",
        "event_id",
        "channel",
        "y",
        "frame",
        "n_rows",
        ((F.col("us") - F.col("us0")) / F.lit(3.6e9)).alias("t"),
        condition().alias("condition"),
        arm().alias("arm"),
    )


def condition():
    """Every third user is a control."""
    return F.when(F.col("trace_id") % 3 == 0, F.lit("ASP")).otherwise(F.lit("EP"))


def arm():
    return F.when(F.col("trace_id") % 2 == 0, F.lit("100us")).otherwise(F.lit("5ms"))


TRACES = """
WITH tr AS (
  SELECT user_id AS trace_id, event_id, event_type AS channel, value AS y,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
    count(*) OVER (PARTITION BY user_id) AS n_rows,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000000.0::DOUBLE AS t,
    CASE WHEN user_id % 3 = 0 THEN 'ASP' ELSE 'EP' END AS condition,
    CASE WHEN user_id % 2 = 0 THEN '100us' ELSE '5ms' END AS arm
  FROM events)
"""


def marked(df: DataFrame) -> DataFrame:
    """Traces with the marker: the first 'error' row of a pulsed trace, its frame and time."""
    hit = (F.col("channel") == "error") & (F.col("condition") == "EP")
    marks = summarise(
        df,
        KEYS,
        F.min(F.when(hit, F.col("frame"))).alias("marker_frame"),
        F.min(F.when(hit, F.col("t"))).alias("marker_t"),
    )
    return attach(df, marks, KEYS)


MARKED = TRACES + """
, mk AS (
  SELECT tr.*,
    min(CASE WHEN channel = 'error' AND condition = 'EP' THEN frame END) OVER (PARTITION BY trace_id) AS marker_frame,
    min(CASE WHEN channel = 'error' AND condition = 'EP' THEN t END) OVER (PARTITION BY trace_id) AS marker_t
  FROM tr)
"""
