"""Streaming runs over the events table, read as a file stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.operators.events import Settings
from sparktraces.plans.registry import query, rounded, sql_round, table
from sparktraces.streaming import live

S = Settings(spike_sigma=60.0, sum_factor=60.0)
PART = "PARTITION BY user_id ORDER BY ts, event_id"


#: How long after its event time a row may arrive.
LATE = "6 hours"


def events_in_utc(spark, sf_dir):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.timestamp_micros(us).alias("at"))


def event_stream(spark, sf_dir, batches=6):
    """events as a stream of some batches, each row up to six hours after its event time, with its closing."""
    rows = events_in_utc(spark, sf_dir)
    delay = F.pmod(F.xxhash64("event_id"), F.lit(6 * 3_600_000_000 - 1))
    return live.closing(live.replayed(rows, F.unix_micros("at") + delay, batches), "at")


@query(
    "online_cusum",
    "Z1",
    f"""
WITH e AS (SELECT user_id, value AS y, row_number() OVER ({PART}) - 1 AS frame, quantile_cont(value, [0.25, 0.5, 0.75]) OVER ({PART} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS q FROM events),
s AS (SELECT user_id, frame, y, q[2] AS mu, greatest(least((q[3] - q[1]) * 0.7413::DOUBLE, 1.0), 1.0) AS sigma FROM e),
d AS (SELECT *, CASE WHEN frame >= 8 THEN y - mu - greatest(0.2, 0.5 * sigma) END AS dev FROM s),
i AS (SELECT *, sum(CASE WHEN coalesce(dev <= 0, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM d),
c AS (SELECT *, sum(CASE WHEN dev > 0 THEN dev ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY frame) AS total FROM i)
SELECT user_id, min(frame) AS at_frame, 'drift' AS kind FROM c WHERE total > greatest(2.0, {S.sum_factor} * sigma) GROUP BY user_id
UNION ALL SELECT user_id, min(frame), 'spike' FROM c WHERE frame >= 8 AND y - mu > {S.spike_sigma} * sigma GROUP BY user_id
""",
)
def online_cusum(spark, sf_dir):
    stream, close = event_stream(spark, sf_dir, batches=30)
    return live.drain(live.online_alarms(stream, "user_id", "at", "value", settings=S, late=LATE), "alarms", close=close)


def shown(out, *groups):
    return live.before_end(out).select(
        *groups, F.unix_seconds("window.start").alias("starts"), "n", rounded("mean", 8).alias("mean"), rounded("peak").alias("peak")
    )


@query(
    "window_stream",
    "Z2",
    f"""
WITH w AS (SELECT event_type, epoch_us(ts) // 86400000000 AS day, value FROM events)
SELECT event_type, day * 86400 AS starts, count(*) AS n, {sql_round('avg(value)', 8)} AS mean, {sql_round('max(value)')} AS peak FROM w GROUP BY event_type, day
""",
)
def window_stream(spark, sf_dir):
    stream, close = event_stream(spark, sf_dir)
    out = live.window_summary(stream, ["event_type"], "at", "value", length="1 day", late=LATE)
    return shown(live.drain(out, "windows", close=close), "event_type")


@query(
    "sliding_stream",
    "Z2",
    f"""
WITH w AS (SELECT event_type, epoch_us(ts) // 43200000000 - i AS half, value FROM events, range(2) r(i))
SELECT event_type, half * 43200 AS starts, count(*) AS n, {sql_round('avg(value)', 8)} AS mean, {sql_round('max(value)')} AS peak FROM w GROUP BY event_type, half
""",
)
def sliding_stream(spark, sf_dir):
    stream, close = event_stream(spark, sf_dir)
    out = live.window_summary(stream, ["event_type"], "at", "value", length="1 day", slide="12 hours", late=LATE)
    return shown(live.drain(out, "slides", close=close), "event_type")


@query(
    "session_stream",
    "Z2",
    f"""
WITH g AS (SELECT user_id, ts, value, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER ({PART}) >= 43200000000, true) AS opens FROM events),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS starts, count(*) AS n, {sql_round('avg(value)', 8)} AS mean, {sql_round('max(value)')} AS peak FROM s GROUP BY user_id, session
""",
)
def session_stream(spark, sf_dir):
    stream, close = event_stream(spark, sf_dir)
    out = live.session_summary(stream, ["user_id"], "at", "value", gap="12 hours", late=LATE)
    return shown(live.drain(out, "sessions", close=close), "user_id")
