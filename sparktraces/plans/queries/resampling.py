"""Interpolation and ensembles over the event traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.operators import cohorts, resample
from sparktraces.plans.bindings import KEYS, MARKED, TRACES, marked, traces
from sparktraces.plans.registry import query, rounded, sql_round

PART = "PARTITION BY trace_id ORDER BY frame"


def grid_sql(start: float, step: float) -> str:
    """SQL for the grid that ends at the first point at or past the last time."""
    return f"gr AS (SELECT i, {start!r}::DOUBLE + i * {step!r}::DOUBLE AS g FROM (SELECT unnest(range(CAST(ceil((max(t) - {start!r}::DOUBLE) / {step!r}::DOUBLE) AS BIGINT) + 1)) AS i FROM tr))"


FLAT = (
    TRACES
    + f", sg AS (SELECT *, lead(t) OVER ({PART}) AS t1, lead(y) OVER ({PART}) AS y1 FROM tr), gr AS (SELECT i, 0.0::DOUBLE + i * st AS g FROM (SELECT max(t) / 89 AS st FROM tr), range(90) r(i)), "
    + "ip AS (SELECT trace_id, arm, i, g, CASE WHEN g <= t OR t1 IS NULL THEN y ELSE y + (y1 - y) / (t1 - t) * (g - t) END AS value "
    + "FROM sg JOIN gr ON g >= t AND (g < t1 OR (t1 IS NULL AND g = t)))"
)


@query("interp_linear", "R1 R7 J10 U3", FLAT + f"SELECT trace_id, i, {sql_round('value', 5)} AS value FROM ip")
def interp_linear(spark, sf_dir):
    rows = cohorts.first_unique_times(
        traces(spark, sf_dir).select("trace_id", "arm", "frame", "t", "y"), KEYS, "t", "frame"
    )
    out = resample.interpolate(rows, KEYS, "t", "y", **resample.grid_over(rows, "t", 90))
    return out.select("trace_id", "i", rounded("value", 5).alias("value"))


@query(
    "interp_hold",
    "R2",
    TRACES
    + f", sg AS (SELECT *, lead(t) OVER ({PART}) AS t1, lead(y) OVER ({PART}) AS y1, lag(t) OVER ({PART}) AS pt FROM tr), {grid_sql(-20.0, 10.0)} "
    + f"SELECT trace_id, i, {sql_round('CASE WHEN g <= t OR t1 IS NULL THEN y ELSE y + (y1 - y) / (t1 - t) * (g - t) END', 5)} AS value "
    + "FROM sg JOIN gr ON (g >= t AND (g < t1 OR (t1 IS NULL AND g = t))) OR (pt IS NULL AND g < t) OR (t1 IS NULL AND g > t)",
)
def interp_hold(spark, sf_dir):
    rows = traces(spark, sf_dir)
    out = resample.interpolate(rows, KEYS, "t", "y", **resample.grid_to_end(rows, "t", start=-20.0, step=10.0), hold=True)
    return out.select("trace_id", "i", rounded("value", 5).alias("value"))


END = """CASE WHEN sign(({a}) ) <> sign({m0}) THEN 0 WHEN sign({m0}) <> sign({m1}) AND abs({a}) > 3 * abs({m0}) THEN 3 * {m0} ELSE {a} END"""


def end_sql(h0, h1, m0, m1):
    return END.format(a=f"((2 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1})", m0=m0, m1=m1)


PCHIP = (
    TRACES
    + f""", a AS (SELECT *, lead(t) OVER ({PART}) AS t1, lead(y) OVER ({PART}) AS y1 FROM tr),
b AS (SELECT *, t1 - t AS h, (y1 - y) / (t1 - t) AS m FROM a),
c AS (SELECT *, lag(h) OVER ({PART}) AS hb, lag(m) OVER ({PART}) AS mb, lag(h, 2) OVER ({PART}) AS hbb, lag(m, 2) OVER ({PART}) AS mbb,
  lead(h) OVER ({PART}) AS hf, lead(m) OVER ({PART}) AS mf FROM b),
d AS (SELECT *, CASE WHEN mb IS NULL THEN {end_sql('h', 'hf', 'm', 'mf')} WHEN m IS NULL THEN {end_sql('hb', 'hbb', 'mb', 'mbb')}
  WHEN mb * m <= 0 THEN 0 ELSE (3 * h + 3 * hb) / ((2 * h + hb) / mb + (h + 2 * hb) / m) END AS d FROM c),
e AS (SELECT *, lead(d) OVER ({PART}) AS d1 FROM d),
{grid_sql(0.0, 3.5)},
f AS (SELECT trace_id, condition, arm, i, y, y1, h, d, d1, t1, (g - t) / h AS s FROM e JOIN gr ON g >= t AND (g < t1 OR (t1 IS NULL AND g = t))),
pc AS (SELECT trace_id, condition, arm, i, CASE WHEN t1 IS NULL THEN y ELSE y * (1 + 2 * s) * (1 - s) * (1 - s) + d * h * s * (1 - s) * (1 - s) + y1 * s * s * (3 - 2 * s) + d1 * h * s * s * (s - 1) END AS value FROM f)
"""
)


@query("interp_pchip", "R3", PCHIP + f"SELECT trace_id, i, {sql_round('value', 5)} AS value FROM pc")
def interp_pchip(spark, sf_dir):
    rows = traces(spark, sf_dir)
    out = resample.interpolate_pchip(rows, KEYS, "t", "y", **resample.grid_to_end(rows, "t", start=0.0, step=3.5))
    return out.select("trace_id", "i", rounded("value", 5).alias("value"))


WINDOW = 240.0
POINTS = 120
W_STEP = resample.linear_grid(-WINDOW, WINDOW, POINTS)["step"]

AROUND = (
    MARKED
    + f""", al AS (SELECT trace_id, arm, frame, t - marker_t AS t, y FROM mk WHERE condition <> 'ASP' AND t - marker_t BETWEEN -{WINDOW} AND {WINDOW}),
sz AS (SELECT arm, count(DISTINCT trace_id) AS traces FROM al GROUP BY arm),
sg AS (SELECT *, lead(t) OVER ({PART}) AS t1, lead(y) OVER ({PART}) AS y1 FROM al),
gr AS (SELECT i, -{WINDOW}::DOUBLE + i * {W_STEP!r}::DOUBLE AS g FROM range({POINTS}) r(i)),
ip AS (SELECT trace_id, arm, i, g, CASE WHEN g <= t OR t1 IS NULL THEN y ELSE y + (y1 - y) / (t1 - t) * (g - t) END AS value
  FROM sg JOIN gr ON g >= t AND (g < t1 OR (t1 IS NULL AND g = t)))
"""
)


def around_marker(spark, sf_dir):
    rows = marked(traces(spark, sf_dir)).filter(
        (F.col("condition") != "ASP") & (F.col("t") - F.col("marker_t")).between(-WINDOW, WINDOW)
    )
    return rows.select("trace_id", "arm", "frame", (F.col("t") - F.col("marker_t")).alias("t"), "y")


@query(
    "marker_ensemble",
    "R8 F4 W2",
    AROUND
    + f"""SELECT arm, i, {sql_round('max(g)')} AS grid, {sql_round('avg(value)')} AS mean, {sql_round('stddev_pop(value)')} AS sd, count(*) AS n
FROM ip GROUP BY arm, i HAVING count(*) >= (SELECT greatest(1, ceil(0.25 * traces)) FROM sz WHERE sz.arm = ip.arm)""",
)
def marker_ensemble(spark, sf_dir):
    """Mean and SD of the value around the marker, per arm."""
    rows = around_marker(spark, sf_dir)
    grid = resample.linear_grid(-WINDOW, WINDOW, POINTS)
    points = resample.interpolate(rows, KEYS, "t", "y", **grid)
    out = resample.ensemble_mean(points, resample.bucket_sizes(rows, KEYS, ["arm"]), ["arm"])
    return out.select("arm", "i", rounded("grid").alias("grid"), rounded("mean").alias("mean"), rounded("sd").alias("sd"), "n")


@query(
    "ensemble_quartiles",
    "R9",
    AROUND
    + f"""SELECT arm, i, {sql_round('quantile_cont(value, 0.25)', 5)} AS q25, {sql_round('quantile_cont(value, 0.5)', 5)} AS median,
  {sql_round('quantile_cont(value, 0.75)', 5)} AS q75, count(*) AS n
FROM ip GROUP BY arm, i HAVING count(*) >= (SELECT greatest(1, floor(0.25 * traces)) FROM sz WHERE sz.arm = ip.arm)""",
)
def ensemble_quartiles(spark, sf_dir):
    rows = around_marker(spark, sf_dir)
    points = resample.interpolate(rows, KEYS, "t", "y", **resample.linear_grid(-WINDOW, WINDOW, POINTS))
    out = resample.ensemble_quartiles(points, resample.bucket_sizes(rows, KEYS, ["arm"]), ["arm"])
    return out.select("arm", "i", *[rounded(c, 5).alias(c) for c in ("q25", "median", "q75")], "n")


@query(
    "trace_end_cap",
    "A33",
    TRACES
    + f", en AS (SELECT trace_id, arm, max(t) AS e FROM tr GROUP BY trace_id, arm) "
    + f"SELECT arm, count(*) AS traces, {sql_round('quantile_cont(e, 0.95)', 5)} AS cap FROM en GROUP BY arm",
)
def trace_end_cap(spark, sf_dir):
    out = resample.end_percentile(traces(spark, sf_dir), KEYS, ["arm"], "t")
    return out.select("arm", "traces", rounded("cap", 5).alias("cap"))


@query(
    "ensemble_mean_step",
    "R6 R10 R13",
    TRACES
    + f""", dt AS (SELECT *, t - lag(t) OVER ({PART}) AS dt FROM tr),
gd AS (SELECT arm, avg(dt) AS step, max(t) AS e, CAST(ceil((max(t) + avg(dt)) / avg(dt)) AS BIGINT) AS points, count(DISTINCT trace_id) AS traces FROM dt GROUP BY arm),
sg AS (SELECT *, lead(t) OVER ({PART}) AS t1, lead(y) OVER ({PART}) AS y1 FROM tr),
gp AS (SELECT arm, step, traces, unnest(range(points)) AS i FROM gd),
ip AS (SELECT sg.arm, traces, i, CASE WHEN i * step <= t OR t1 IS NULL THEN y ELSE y + (y1 - y) / (t1 - t) * (i * step - t) END AS value
  FROM sg JOIN gp ON gp.arm = sg.arm AND i * step >= t AND (i * step < t1 OR (t1 IS NULL AND i * step = t)))
SELECT arm, i, {sql_round('avg(value)')} AS mean, {sql_round('stddev_pop(value) / sqrt(count(*))')} AS sem, count(*) AS n, bool_and(traces >= 3) AS aggregate_ok
FROM ip GROUP BY arm, i HAVING count(*) >= greatest(1, ceil(0.25 * max(traces)))""",
)
def ensemble_mean_step(spark, sf_dir):
    rows = traces(spark, sf_dir).select("trace_id", "arm", "frame", "t", "y")
    grids = resample.mean_step_grid(rows, KEYS, ["arm"], "t")
    points = resample.interpolate(
        rows.join(grids, "arm"), KEYS, "t", "y", start=0.0, step=F.col("step"), points=F.col("points")
    )
    out = resample.ensemble_mean(points, resample.bucket_sizes(rows, KEYS, ["arm"]), ["arm"])
    return out.select("arm", "i", rounded("mean").alias("mean"), rounded("sem").alias("sem"), "n", "aggregate_ok")


@query(
    "ensemble_pchip",
    "R3 R8",
    PCHIP
    + f""", sz AS (SELECT condition, arm, count(DISTINCT trace_id) AS traces FROM tr GROUP BY ALL)
SELECT pc.condition, pc.arm, i, {sql_round('avg(value)', 5)} AS mean, {sql_round('stddev_pop(value)', 5)} AS sd, count(*) AS n
FROM pc JOIN sz ON sz.condition = pc.condition AND sz.arm = pc.arm GROUP BY ALL HAVING count(*) >= greatest(1, ceil(0.25 * max(traces)))""",
)
def ensemble_pchip(spark, sf_dir):
    rows = traces(spark, sf_dir).select("trace_id", "condition", "arm", "frame", "t", "y")
    points = resample.interpolate_pchip(rows, KEYS, "t", "y", **resample.grid_to_end(rows, "t", start=0.0, step=3.5))
    by = ["condition", "arm"]
    out = resample.ensemble_mean(points, resample.bucket_sizes(rows, KEYS, by), by)
    return out.select(*by, "i", rounded("mean", 5).alias("mean"), rounded("sd", 5).alias("sd"), "n")


@query(
    "ref_time_value",
    "R4 R5",
    MARKED
    + f""", al AS (SELECT trace_id, frame, t - marker_t AS t, y FROM mk WHERE condition <> 'ASP'),
po AS (SELECT * FROM al WHERE t >= 0),
sg AS (SELECT *, lead(t) OVER ({PART}) AS t1, lead(y) OVER ({PART}) AS y1 FROM po),
rd AS (SELECT trace_id, CASE WHEN 300.0 <= t OR t1 IS NULL THEN y ELSE y + (y1 - y) / (t1 - t) * (300.0 - t) END AS value FROM sg WHERE 300.0 >= t AND (300.0 < t1 OR (t1 IS NULL AND 300.0 = t))),
kn AS (SELECT trace_id, count(*) AS n, max(t) AS e FROM po GROUP BY trace_id),
bs AS (SELECT trace_id, arg_min(y, frame) AS f0 FROM al GROUP BY trace_id),
st AS (SELECT bs.trace_id, f0, value, CASE WHEN coalesce(n, 0) < 5 THEN 'no_trace' WHEN e < 300.0 THEN 'short_record' ELSE 'found' END AS status
  FROM bs LEFT JOIN kn ON kn.trace_id = bs.trace_id LEFT JOIN rd ON rd.trace_id = bs.trace_id)
SELECT trace_id, status, {sql_round("CASE WHEN status = 'found' THEN value - f0 END", 5)} AS value FROM st""",
)
def ref_time_value(spark, sf_dir):
    rows = (
        marked(traces(spark, sf_dir))
        .filter(F.col("condition") != "ASP")
        .select("trace_id", "frame", (F.col("t") - F.col("marker_t")).alias("t"), "y")
    )
    out = resample.value_at(rows, KEYS, "t", "y", 300.0, baseline=F.min_by("y", "frame"))
    return out.select("trace_id", "status", rounded("value", 5).alias("value"))


@query(
    "reaching_split",
    "R12 R15",
    TRACES
    + f""", en AS (SELECT *, max(t) OVER (PARTITION BY trace_id) AS e FROM tr),
k AS (SELECT * FROM en WHERE e >= 0.5 * 1400.0),
nr AS (SELECT trace_id, arg_min(t, (abs(t - 300.0), t)) AS near_t FROM k GROUP BY trace_id)
SELECT k.trace_id, CASE WHEN t < near_t THEN 'before' ELSE 'after' END AS part, count(*) AS n, {sql_round('avg(y)', 8)} AS mean
FROM k JOIN nr ON nr.trace_id = k.trace_id GROUP BY ALL""",
)
def reaching_split(spark, sf_dir):
    rows = resample.reaching(traces(spark, sf_dir), KEYS, "t", 1400.0)
    parts = resample.split_at(rows, KEYS, "t", 300.0)
    return parts.groupBy("trace_id", "part").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("y"), 8).alias("mean"))
