"""Event detection over the event traces.

The value is the signal; its tenth is the length and its double the body area,
so thresholds of the detectors meet real variation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.operators import axes, events
from sparktraces.operators.events import KINDS, Settings
from sparktraces.operators.stage import staged
from sparktraces.plans.bindings import KEYS, MARKED, marked, traces
from sparktraces.plans.registry import query, rounded, sql_round

PART = "PARTITION BY trace_id ORDER BY frame"
S = Settings(spike_sigma=60.0, step_sigma=40.0, sum_factor=60.0)


def signal(spark, sf_dir):
    y = F.col("y")
    return (
        marked(traces(spark, sf_dir))
        .withColumn("len", y / 10)
        .withColumn("area", y * 2)
        .withColumn("solidity", F.lit(1.0) - F.col("frame") / F.lit(20.0))
    )


def bounds_of(df):
    entry = events.sustained_entry(df, KEYS, "len", "area", threshold=1.0, channel_length=30.0)
    return events.sustained_exit(df, KEYS, "len", entry, marker="marker_frame", threshold=1.5, drop_ratio=0.5)


SIGNAL = MARKED + f"""
, sg AS (SELECT *, y / 10 AS len, y * 2 AS area, 1.0::DOUBLE - frame / 20.0::DOUBLE AS solidity FROM mk),
ok AS (SELECT *, len > 1.0 AND len < 27.0 AND area >= 10 AS ok FROM sg),
rn AS (SELECT *, ok AND coalesce(lead(ok, 1) OVER ({PART}), false) AND coalesce(lead(ok, 2) OVER ({PART}), false) AS ok3 FROM ok),
ent AS (SELECT trace_id, max(n_rows) AS n, CAST(coalesce(greatest(0, min(CASE WHEN ok3 THEN frame END) - 1), 0) AS BIGINT) AS entry_frame,
    count(CASE WHEN ok3 THEN 1 END) > 0 AS entry_confirmed FROM rn GROUP BY trace_id),
lg AS (SELECT *, lag(len) OVER ({PART}) AS plen FROM sg),
ls AS (SELECT *, (len < 1.5 OR (plen > 3 AND len < 0.5 * plen)) AND NOT coalesce(frame BETWEEN marker_frame - 1 AND marker_frame + 5, false) AS lost FROM lg),
l3 AS (SELECT *, coalesce(lost, false) AND coalesce(lead(lost, 1) OVER ({PART}), false) AND coalesce(lead(lost, 2) OVER ({PART}), false) AS lost3 FROM ls),
bd AS (SELECT ent.trace_id, any_value(entry_frame) AS entry_frame, any_value(entry_confirmed) AS entry_confirmed, any_value(n) AS n,
    CAST(coalesce(min(CASE WHEN lost3 AND frame >= entry_frame + 5 THEN frame END), any_value(n)) AS BIGINT) AS exit_frame
  FROM ent JOIN l3 ON l3.trace_id = ent.trace_id GROUP BY ent.trace_id)
"""

ACTIVE = SIGNAL + f"""
, q AS (SELECT *, quantile_cont(y, [0.25, 0.5, 0.75]) OVER ({PART} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS q FROM sg),
ac AS (SELECT q.trace_id, frame, t, y, len, frame - entry_frame AS rel, least(n, exit_frame + 3) - entry_frame AS active,
    q[2] AS mu, greatest(least((q[3] - q[1]) * 0.7413::DOUBLE, 1.0), 1.0) AS sigma
  FROM q JOIN bd ON q.trace_id = bd.trace_id
  WHERE entry_confirmed AND frame >= entry_frame AND frame < least(n, exit_frame + 3))
"""

DRIFT = f"""
, hd AS (SELECT trace_id, quantile_cont(y, 0.5) AS hm, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS hiqr FROM ac WHERE rel < 3 GROUP BY trace_id),
dv AS (SELECT ac.*, CASE WHEN active < 9 THEN hm ELSE mu END AS m,
    CASE WHEN active < 9 THEN greatest(least(hiqr * 0.7413::DOUBLE, 1.0), 1.0) ELSE sigma END AS sg
  FROM ac JOIN hd ON hd.trace_id = ac.trace_id),
dw AS (SELECT *, CASE WHEN rel >= CASE WHEN active < 9 THEN 3 ELSE 8 END THEN y - m - greatest(0.2, 0.5 * sg) END AS dev, greatest(2.0, {S.sum_factor} * sg) AS h FROM dv),
di AS (SELECT *, sum(CASE WHEN coalesce(dev <= 0, true) THEN 1 ELSE 0 END) OVER ({PART}) AS island FROM dw),
ds AS (SELECT *, sum(CASE WHEN dev > 0 THEN dev ELSE 0 END) OVER (PARTITION BY trace_id, island ORDER BY frame) AS s FROM di)
"""

JUMP = f"""
, st AS (SELECT *, y - lag(y) OVER ({PART}) AS step FROM ac),
jr AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY step DESC, frame) AS k FROM st WHERE rel > 3)
"""

ANCHOR = f"""
, am AS (SELECT *, quantile_cont(y, 0.5) OVER ({PART} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS wm FROM ac),
an AS (SELECT trace_id, quantile_cont(y, 0.5) AS anchor FROM ac WHERE rel < 5 GROUP BY trace_id),
ar AS (SELECT am.trace_id, min(frame) AS at_frame FROM am JOIN an ON an.trace_id = am.trace_id
  WHERE active > 10 AND anchor >= 1 AND rel >= 5 AND rel <= active - 5 AND wm >= 1.5 * anchor AND wm - anchor >= 1.0 GROUP BY am.trace_id)
"""

CONTEXT = """
, mn AS (SELECT sg.trace_id, sg.frame - marker_frame AS o, marker_frame, y FROM sg JOIN bd ON bd.trace_id = sg.trace_id
  WHERE entry_confirmed AND marker_frame - 5 >= entry_frame AND marker_frame > entry_frame AND marker_frame + 5 < n
    AND sg.frame BETWEEN marker_frame - 5 AND marker_frame + 5),
ms AS (SELECT trace_id, max(marker_frame) AS at_frame, quantile_cont(y, 0.5) FILTER (WHERE o < 0) AS pre,
    quantile_cont(y, 0.5) FILTER (WHERE o > 0) AS post, max(y) FILTER (WHERE o BETWEEN 1 AND 2) AS peak FROM mn GROUP BY trace_id),
mc AS (SELECT trace_id, at_frame FROM ms WHERE pre >= 0.1 AND ((post >= 1.3 * pre AND post - pre >= 0.5) OR (peak >= 1.3 * pre AND peak - pre >= 0.5)))
"""

ENTRY_QUALITY = """
, eq AS (SELECT sg.trace_id, max(entry_frame) AS at_frame, quantile_cont(y, 0.5) FILTER (WHERE frame < entry_frame) AS empty,
    quantile_cont(y, 0.5) FILTER (WHERE frame BETWEEN entry_frame AND entry_frame + 2) AS sig, max(solidity) FILTER (WHERE frame = entry_frame) AS solid
  FROM sg JOIN bd ON bd.trace_id = sg.trace_id WHERE entry_confirmed AND entry_frame > 0 GROUP BY sg.trace_id),
ec AS (SELECT trace_id, at_frame FROM eq WHERE sig >= greatest(empty, 1.0) * 0.8 AND solid < 0.85)
"""

CANDIDATES = ACTIVE + DRIFT + JUMP + ANCHOR + CONTEXT + ENTRY_QUALITY + f"""
, cd AS (
  SELECT trace_id, min(frame) AS at_frame, 'spike' AS kind FROM ac WHERE rel >= 8 AND y - mu > {S.spike_sigma} * sigma GROUP BY trace_id
  UNION ALL SELECT trace_id, min(frame), 'step' FROM ac WHERE rel >= 8 AND y - mu > {S.step_sigma} * sigma GROUP BY trace_id
  UNION ALL SELECT trace_id, frame, 'jump' FROM jr WHERE k = 1 AND step > 1.0
  UNION ALL SELECT trace_id, min(frame), 'drift' FROM ds WHERE s > h GROUP BY trace_id
  UNION ALL SELECT trace_id, at_frame, 'anchored_rise' FROM ar
  UNION ALL SELECT trace_id, at_frame, 'marker' FROM mc
  UNION ALL SELECT trace_id, at_frame, 'not_displaced' FROM ec)
"""


@query("sustained_entry", "W12", SIGNAL + "SELECT trace_id, entry_frame, entry_confirmed FROM ent")
def sustained_entry(spark, sf_dir):
    out = events.sustained_entry(signal(spark, sf_dir), KEYS, "len", "area", threshold=1.0, channel_length=30.0)
    return out.select("trace_id", "entry_frame", "entry_confirmed")


@query("sustained_exit", "W13", SIGNAL + "SELECT trace_id, entry_frame, exit_frame FROM bd")
def sustained_exit(spark, sf_dir):
    return bounds_of(signal(spark, sf_dir)).select("trace_id", "entry_frame", "exit_frame")


@query(
    "active_values",
    "F18 F19",
    SIGNAL
    + f"""SELECT trace_id, count(active_len) AS n_active, {sql_round('max(active_len)')} AS max_len, bool_or(active_len > 0) AS any_positive
FROM (SELECT sg.trace_id, CASE WHEN frame BETWEEN entry_frame AND exit_frame THEN len END AS active_len FROM sg JOIN bd ON bd.trace_id = sg.trace_id)
GROUP BY trace_id""",
)
def active_values(spark, sf_dir):
    df = signal(spark, sf_dir)
    rows = events.attach(df, bounds_of(df), KEYS)
    kept = axes.active_only(F.col("len"), F.col("frame"), F.col("entry_frame"), F.col("exit_frame"))
    return (
        rows.withColumn("active_len", kept)
        .groupBy("trace_id")
        .agg(
            F.count("active_len").alias("n_active"),
            rounded(F.max("active_len")).alias("max_len"),
            F.bool_or(F.col("active_len") > 0).alias("any_positive"),
        )
    )


@query("rolling_sigma", "W14", ACTIVE + f"SELECT trace_id, frame, {sql_round('mu')} AS mu, {sql_round('sigma')} AS sigma FROM ac WHERE rel >= 5")
def rolling_sigma(spark, sf_dir):
    df = signal(spark, sf_dir)
    rows = events.active_rows(df, KEYS, bounds_of(df), "y", S).filter(F.col("rel") >= 5)
    return rows.select("trace_id", "frame", rounded("_base.mu").alias("mu"), rounded("_base.sigma").alias("sigma"))


def _single(name, covers, tail, build):
    @query(name, covers, tail)
    def run(spark, sf_dir):
        df = staged(signal(spark, sf_dir))
        return build(df, staged(bounds_of(df))).select("trace_id", "at_frame")

    return run


def _alarm(df, bounds, kind):
    wide = events.alarms(events.active_rows(df, KEYS, bounds, "y", S), KEYS, "y", S)
    return wide.filter(F.col(kind).isNotNull()).withColumn("at_frame", F.col(kind))


_single(
    "spike_alarm", "W15",
    ACTIVE + f"SELECT trace_id, min(frame) AS at_frame FROM ac WHERE rel >= 8 AND y - mu > {S.spike_sigma} * sigma GROUP BY trace_id",
    lambda df, b: _alarm(df, b, "spike"),
)
_single(
    "drift_alarm", "W16",
    ACTIVE + DRIFT + "SELECT trace_id, min(frame) AS at_frame FROM ds WHERE s > h GROUP BY trace_id",
    lambda df, b: _alarm(df, b, "drift"),
)
_single(
    "sudden_jump", "W17",
    ACTIVE + JUMP + "SELECT trace_id, frame AS at_frame FROM jr WHERE k = 1 AND step > 1.0",
    lambda df, b: _alarm(df, b, "jump"),
)
_single(
    "anchored_rise", "W18",
    ACTIVE + ANCHOR + "SELECT trace_id, at_frame FROM ar",
    lambda df, b: _alarm(df, b, "anchored_rise"),
)
_single(
    "entry_quality", "W19",
    SIGNAL + ENTRY_QUALITY + "SELECT trace_id, at_frame FROM ec",
    lambda df, b: events.displacement_check(df, KEYS, "y", "solidity", b, S),
)
_single(
    "marker_context", "W20",
    SIGNAL + CONTEXT + "SELECT trace_id, at_frame FROM mc",
    lambda df, b: events.marker_alarm(df, KEYS, "y", b, "marker_frame", S),
)


ORDER = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))


@query(
    "veto_arbitrate",
    "W21 W22 O5 O6",
    CANDIDATES
    + f"""
, nr AS (SELECT cd.trace_id, kind, at_frame, sg.frame - at_frame AS o, y, CASE WHEN sg.frame BETWEEN entry_frame AND exit_frame THEN len END AS len
  FROM cd JOIN bd ON bd.trace_id = cd.trace_id LEFT JOIN sg ON sg.trace_id = cd.trace_id AND sg.frame BETWEEN at_frame - 10 AND at_frame + 9),
sc AS (SELECT trace_id, kind, at_frame, quantile_cont(y, 0.5) FILTER (WHERE o BETWEEN -5 AND -1) AS pre,
    quantile_cont(y, 0.5) FILTER (WHERE o BETWEEN 0 AND 4) AS post,
    least(count(y) FILTER (WHERE o BETWEEN -5 AND -1), count(y) FILTER (WHERE o BETWEEN 0 AND 4)) AS ns,
    avg(len) FILTER (WHERE o < 0) AS lpre, avg(len) FILTER (WHERE o >= 0) AS lpost,
    least(count(len) FILTER (WHERE o < 0), count(len) FILTER (WHERE o >= 0)) AS nl FROM nr GROUP BY ALL),
fr AS (SELECT trace_id, quantile_cont(y, 0.5) AS start FROM ac WHERE rel < 5 GROUP BY trace_id),
kp AS (SELECT sc.* FROM sc LEFT JOIN fr ON fr.trace_id = sc.trace_id
  WHERE kind IN ('not_displaced', 'marker') OR nl < 3
    OR (ns >= 2 AND ((pre > 0 AND post / pre >= 2.0 AND post - pre >= 5.0) OR (start > 0 AND post / start >= 1.7 AND post - start >= 3.0)))
    OR (lpre > 0 AND lpost / lpre < 0.9)),
ft AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY at_frame, CASE kind {ORDER} END) AS k FROM kp)
SELECT bd.trace_id, entry_confirmed, kind IS NOT NULL AS event_found, CASE WHEN kind IS NOT NULL THEN least(at_frame, greatest(0, exit_frame - 1)) END AS event_frame, kind AS event_kind
FROM bd LEFT JOIN ft ON ft.trace_id = bd.trace_id AND k = 1
""",
)
def veto_arbitrate(spark, sf_dir):
    df = staged(signal(spark, sf_dir))
    bounds = staged(bounds_of(df))
    found = events.candidates(df, KEYS, "y", bounds, marker="marker_frame", solidity="solidity", settings=S)
    kept = events.veto(df, KEYS, "y", "len", found, bounds, settings=S)
    return events.arbitrate(kept, bounds, KEYS).select("trace_id", "entry_confirmed", "event_found", "event_frame", "event_kind")
