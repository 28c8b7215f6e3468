"""Axes, smoothing and other ordered columns over the event traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.operators import axes, cohorts, smoothing
from sparktraces.operators.sequence import renumber, with_summary
from sparktraces.plans.bindings import KEYS, MARKED, TRACES, marked, traces
from sparktraces.plans.registry import query, rounded, sql_round

PART = "PARTITION BY trace_id ORDER BY frame"


@query("elapsed_axis", "W1 O5", TRACES + f"SELECT event_id, trace_id, frame, n_rows, {sql_round('t - first_t')} AS elapsed FROM (SELECT *, first(t) OVER ({PART}) AS first_t FROM tr)")
def elapsed_axis(spark, sf_dir):
    rows = axes.elapsed(traces(spark, sf_dir), KEYS, "t")
    return rows.select("event_id", "trace_id", "frame", "n_rows", rounded("elapsed").alias("elapsed"))


@query(
    "marker_axis",
    "W2 W27 W30 J11",
    MARKED
    + f"""SELECT event_id, marker_frame, {sql_round("CASE WHEN condition <> 'ASP' THEN t - at_t END")} AS marker_rel,
  {sql_round('at_t')} AS marker_since_start,
  coalesce(frame BETWEEN marker_frame - 1 AND marker_frame + 5, false) AS in_marker_window
FROM (SELECT *, max(CASE WHEN frame = marker_frame THEN t END) OVER (PARTITION BY trace_id) AS at_t FROM mk)""",
)
def marker_axis(spark, sf_dir):
    rows = axes.marker_time(marked(traces(spark, sf_dir)), KEYS, "t", "marker_frame", out="at_t")
    return rows.select(
        "event_id",
        "marker_frame",
        rounded(axes.marker_relative(F.col("t"), F.col("at_t"), F.col("condition"))).alias("marker_rel"),
        rounded("at_t").alias("marker_since_start"),
        axes.marker_flag(F.col("frame"), F.col("marker_frame"), 5).alias("in_marker_window"),
    )


# A length that is zero until a row exceeds 60: the value of the row minus 60, floored at 0.
LEN = TRACES + ", ln AS (SELECT *, greatest(y - 60.0, 0) AS len FROM tr)"


def lengths(spark, sf_dir):
    return traces(spark, sf_dir).withColumn("len", F.greatest(F.col("y") - 60.0, F.lit(0.0)))


@query(
    "entry_axis",
    "W3",
    LEN
    + f"""SELECT event_id, {sql_round('t - te')} AS entry_t
FROM (SELECT *, min(CASE WHEN len > 0 THEN t END) OVER (PARTITION BY trace_id) AS te FROM ln) WHERE t - te >= 0""",
)
def entry_axis(spark, sf_dir):
    rows = axes.since_entry(lengths(spark, sf_dir), KEYS, "t", "len", drop_earlier=True)
    return rows.select("event_id", rounded("entry_t").alias("entry_t"))


@query(
    "start_shift",
    "W4",
    LEN
    + f""", nx AS (SELECT *, lead(len) OVER ({PART}) AS nxt FROM ln),
s AS (SELECT *, coalesce(min(CASE WHEN len > 0.1 AND nxt > 0.1 THEN frame END) OVER (PARTITION BY trace_id), 0) AS sf FROM nx)
SELECT event_id, {sql_round('t - ts')} AS start_t FROM (SELECT *, max(CASE WHEN frame = sf THEN t END) OVER (PARTITION BY trace_id) AS ts FROM s)
WHERE frame >= sf""",
)
def start_shift(spark, sf_dir):
    rows = axes.shift_to_start(lengths(spark, sf_dir), KEYS, "t", "len")
    return rows.select("event_id", rounded("start_t").alias("start_t"))


@query(
    "smooth3",
    "W5 W6",
    TRACES
    + f"""SELECT event_id, {sql_round('CASE WHEN n_rows < 3 THEN y ELSE c END')} AS centred, {sql_round('k')} AS causal
FROM (SELECT *, quantile_cont(y, 0.5) OVER ({PART} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c,
  quantile_cont(y, 0.5) OVER ({PART} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS k FROM tr)""",
)
def smooth3(spark, sf_dir):
    rows = smoothing.median3(traces(spark, sf_dir), KEYS, "y", n_rows="n_rows", out="centred")
    rows = smoothing.causal_median3(rows, KEYS, "y", out="causal")
    return rows.select("event_id", rounded("centred").alias("centred"), rounded("causal").alias("causal"))


# Null rules under test: every 17th value is missing.
HOLES = TRACES + f"""
, ok AS (SELECT trace_id, event_id, t, y, row_number() OVER ({PART}) - 1 AS frame, count(*) OVER (PARTITION BY trace_id) AS n
  FROM tr WHERE event_id % 17 <> 0)
"""


def PADDED(y: str, rows: str = "frame", n: str = "n") -> str:
    return (
        f"list_sort(list_concat(list_resize([]::DOUBLE[], greatest(5 - {rows}, 0), list_extract({y}, 1)), {y}, "
        f"list_resize([]::DOUBLE[], greatest({rows} + 6 - {n}, 0), list_extract({y}, len({y})))))[6]"
    )


#: All rows of the traces under the names of HOLES.
WHOLE = TRACES + """
, ok AS (SELECT trace_id, event_id, t, y, frame, n_rows AS n FROM tr)
"""

CLEAN = f"""
, c1 AS (SELECT *, list(y) OVER ({PART} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS ys FROM ok),
c2 AS (SELECT *, abs(y - {PADDED('ys')}) AS dev FROM c1),
c3 AS (SELECT *, list(dev) OVER ({PART} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS ds FROM c2),
clean AS (SELECT *, n < 11 OR dev <= 2.5 * greatest({PADDED('ds')} * 1.4826, 0.1) AS inlier FROM c3)
"""

CLEANED = WHOLE + CLEAN


def dense(spark, sf_dir):
    """All rows of the traces, with their number ``n``."""
    return traces(spark, sf_dir).withColumnRenamed("n_rows", "n")


def holed(spark, sf_dir):
    """Traces without their missing values, renumbered."""
    rows = traces(spark, sf_dir).drop("n_rows").withColumn("y", F.when(F.col("event_id") % 17 != 0, F.col("y")))
    return renumber(cohorts.valid_points(rows, "t", "y"), KEYS, n_rows="n")


@query("hampel11", "W7 F2", HOLES + CLEAN + "SELECT event_id, frame, n, inlier FROM clean")
def hampel11(spark, sf_dir):
    return smoothing.outlier_free(holed(spark, sf_dir), KEYS, "y", n_rows="n").select("event_id", "frame", "n", "inlier")


@query(
    "outlier_std11",
    "W8 W9 O7",
    HOLES
    + f""", c1 AS (SELECT *, list(y) OVER ({PART} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS ys,
  stddev_samp(y) OVER ({PART} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS sd FROM ok)
SELECT event_id, n <= 11 OR abs(y - {PADDED('ys')}) <= 2.5 * greatest(coalesce(sd, 0), 0.5 * 0.629) AS inlier FROM c1
WHERE frame >= CASE WHEN floor(n * 0.05::DOUBLE) >= n - 5 THEN 0 ELSE floor(n * 0.05::DOUBLE) END""",
)
def outlier_std11(spark, sf_dir):
    rows = smoothing.outlier_free_std(holed(spark, sf_dir), KEYS, "y", n_rows="n")
    return smoothing.drop_leading(rows, fraction=0.05, n_rows="n").select("event_id", "inlier")


@query(
    "derivative",
    "W10",
    TRACES
    + f"""SELECT event_id, {sql_round('(y - py) / CASE WHEN t - pt = 0 THEN 1e-6 ELSE t - pt END', 4)} AS rate
FROM (SELECT *, lag(t) OVER ({PART}) AS pt, lag(y) OVER ({PART}) AS py FROM tr)""",
)
def derivative(spark, sf_dir):
    return smoothing.derivative(traces(spark, sf_dir), KEYS, "t", "y").select("event_id", rounded("rate", 4).alias("rate"))


def WEIGHTED() -> str:
    cases = []
    for i, row in enumerate(smoothing.polynomial_weights(9, 3)):
        terms = " + ".join(f"{v!r}::DOUBLE * list_extract(win, {j + 1})" for j, v in enumerate(row))
        cases.append(f"WHEN {i} THEN {terms}")
    return f"CASE pos {' '.join(cases)} END"


@query(
    "velocity_drop",
    "W11",
    TRACES
    + f""", g AS (SELECT *, list(y) OVER ({PART} ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS near,
  CASE WHEN frame < 4 THEN frame WHEN n_rows - 1 - frame < 4 THEN 8 - (n_rows - 1 - frame) ELSE 4 END AS pos FROM tr WHERE n_rows >= 10),
h AS (SELECT *, CASE WHEN frame < 4 THEN near[1:9] WHEN n_rows - 1 - frame < 4 THEN near[len(near) - 8:len(near)]
  ELSE near[least(frame, 8) - 3:least(frame, 8) + 5] END AS win FROM g),
s AS (SELECT *, {WEIGHTED()} AS s FROM h),
v AS (SELECT *, (s - lag(s) OVER ({PART})) / (t - lag(t) OVER ({PART}) + 1e-10::DOUBLE) AS v FROM s),
l AS (SELECT *, avg(v) OVER (PARTITION BY trace_id) - 2 * stddev_pop(v) OVER (PARTITION BY trace_id) AS lim FROM v)
SELECT trace_id, min(CASE WHEN v < lim AND frame < n_rows - 1 THEN frame END) AS drop_frame,
  {sql_round('min(CASE WHEN v < lim AND frame < n_rows - 1 THEN t END)')} AS drop_t FROM l GROUP BY trace_id""",
)
def velocity_drop(spark, sf_dir):
    out = smoothing.velocity_drop(traces(spark, sf_dir), KEYS, "t", "y", n_rows="n_rows")
    return out.select("trace_id", "drop_frame", rounded("drop_t").alias("drop_t"))


@query(
    "side_slopes",
    "W23 G12",
    TRACES
    + f""", b AS (SELECT *, greatest(5, round_even(n_rows * 0.33::DOUBLE, 0)) AS side FROM tr),
s AS (SELECT trace_id, max(n_rows) AS n, max(t) - min(t) AS duration,
  regr_slope(y, t) FILTER (WHERE frame < side) AS early_slope, regr_slope(y, t) FILTER (WHERE frame >= n_rows - side) AS late_slope FROM b GROUP BY trace_id)
SELECT trace_id, {sql_round('early_slope')} AS early_slope, {sql_round('late_slope')} AS late_slope,
  n >= 5 AND duration > 0 AND abs(coalesce(late_slope, 0)) * duration > 1.5 * 0.3 AS flow_ok,
  n >= 5 AND duration > 0 AND abs(coalesce(early_slope, 0)) >= 1e-9 AND abs(late_slope) < 0.5 * abs(early_slope) AS plateau_ok FROM s""",
)
def side_slopes(spark, sf_dir):
    out = smoothing.side_slopes(traces(spark, sf_dir), KEYS, "t", "y", n_rows="n_rows")
    return out.select(
        "trace_id", rounded("early_slope").alias("early_slope"), rounded("late_slope").alias("late_slope"), "flow_ok", "plateau_ok"
    )


@query(
    "time_to_63",
    "W24 O4",
    TRACES
    + f""", p AS (SELECT *, greatest(max(y) OVER (PARTITION BY trace_id), 1e-9::DOUBLE) AS peak FROM tr),
r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY abs(y - 0.63::DOUBLE * peak), frame) AS k FROM p)
SELECT trace_id, {sql_round('peak')} AS peak, {sql_round('t')} AS t_fraction FROM r WHERE k = 1""",
)
def time_to_63(spark, sf_dir):
    out = smoothing.time_to_fraction(traces(spark, sf_dir), KEYS, "t", "y")
    return out.select("trace_id", rounded("peak").alias("peak"), rounded("t_fraction").alias("t_fraction"))


@query(
    "durbin_watson",
    "W25 G1 G15",
    TRACES
    + f""", c AS (SELECT trace_id, regr_slope(y, t) AS m, regr_intercept(y, t) AS b, regr_r2(y, t) AS r2 FROM tr GROUP BY trace_id),
e AS (SELECT tr.trace_id, frame, y - (m * t + b) AS e, r2 FROM tr JOIN c USING (trace_id)),
d AS (SELECT *, e - lag(e) OVER ({PART}) AS de FROM e)
SELECT trace_id, count(*) AS n, {sql_round('sum(de * de) / sum(e * e)')} AS dw, {sql_round('max(r2)')} AS r2 FROM d GROUP BY trace_id""",
)
def durbin_watson(spark, sf_dir):
    rows = with_summary(
        traces(spark, sf_dir), KEYS, F.regr_slope("y", "t").alias("m"), F.regr_intercept("y", "t").alias("b"), F.var_pop("y").alias("v")
    ).withColumn("e", F.col("y") - (F.col("m") * F.col("t") + F.col("b")))
    total = rows.groupBy(*KEYS).agg(F.max("v").alias("v"))
    out = smoothing.durbin_watson(rows, KEYS, "e").join(total, KEYS)
    r2 = 1 - F.col("rss") / (F.col("v") * F.col("n"))
    return out.select("trace_id", "n", rounded("dw").alias("dw"), rounded(r2).alias("r2"))


@query(
    "densify",
    "W31",
    HOLES.replace("row_number() OVER (PARTITION BY trace_id ORDER BY frame) - 1 AS frame", "frame")
    + f"""SELECT s.trace_id, s.frame, {sql_round('coalesce(o.y, 0)')} AS y
FROM (SELECT trace_id, unnest(range(max(frame) + 1)) AS frame FROM ok GROUP BY trace_id) s
LEFT JOIN ok o ON o.trace_id = s.trace_id AND o.frame = s.frame""",
)
def densify(spark, sf_dir):
    rows = traces(spark, sf_dir).filter(F.col("event_id") % 17 != 0).select("trace_id", "frame", "y")
    return axes.densify(rows, KEYS, fill=0.0).select("trace_id", "frame", rounded("y").alias("y"))


@query(
    "phase_traces",
    "W29 F3 F4",
    MARKED
    + f""", k AS (SELECT * FROM mk WHERE condition = 'ASP' OR (y > 0 AND t < marker_t)),
n AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS kept, first(t) OVER ({PART}) AS t0 FROM k)
SELECT event_id, {sql_round('t - t0')} AS phase_t FROM n WHERE kept >= 5""",
)
def phase_traces(spark, sf_dir):
    rows = axes.before_marker(marked(traces(spark, sf_dir)), KEYS, "t", "y", "condition", "marker_t", min_rows=5)
    return rows.select("event_id", rounded("t").alias("phase_t"))


@query(
    "rebase_after_marker",
    "M27 W26",
    MARKED
    + f""", k AS (SELECT * FROM mk WHERE marker_frame IS NOT NULL AND frame >= marker_frame)
SELECT event_id, {sql_round(f't - first(t) OVER ({PART})')} AS t, {sql_round(f'greatest(y - first(y) OVER ({PART}), 0)')} AS y FROM k""",
)
def rebase_after_marker(spark, sf_dir):
    after = marked(traces(spark, sf_dir)).filter(F.col("frame") >= F.col("marker_frame"))
    out = axes.rebase(after, KEYS, "t", "y")
    return out.select("event_id", rounded("t").alias("t"), rounded("y").alias("y"))
