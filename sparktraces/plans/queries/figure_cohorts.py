"""Correlation cohorts, ensembles at all levels, and the fits of ensemble means."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.functions.physics import behaviour_class
from sparktraces.operators import cohorts, ensembles, fit, resample, stats
from sparktraces.plans.bindings import KEYS, MARKED, marked, traces
from sparktraces.plans.queries.fitting import POINTS_OF_ENSEMBLES, assess_sql, fit_sql
from sparktraces.plans.queries.testing import FITS, fit_rows, rank_sql
from sparktraces.plans.registry import query, rounded, sql_round, table

PART = "PARTITION BY trace_id ORDER BY frame"

# One row a trace. Slopes need three rows, so some are missing.
DESCRIPTORS = MARKED + """
, ds AS (SELECT trace_id, any_value(condition) AS condition, CASE WHEN count(*) FILTER (WHERE frame < marker_frame) >= 3 THEN regr_slope(y, t) FILTER (WHERE frame < marker_frame) END AS pre_slope,
  avg(y) FILTER (WHERE frame < marker_frame) AS pre_mean, max(t) FILTER (WHERE frame < marker_frame) AS pre_duration, max(y) FILTER (WHERE frame < marker_frame) AS pre_peak,
  regr_slope(y, t) AS slope, avg(y) AS mean, max(t) AS duration, max(y) AS peak FROM mk GROUP BY trace_id)
"""
PRE = ["pre_slope", "pre_mean", "pre_duration", "pre_peak"]
WHOLE = ["slope", "mean", "duration", "peak", "pre_slope"]


def descriptors(spark, sf_dir):
    rows = marked(traces(spark, sf_dir))
    before = F.col("frame") < F.col("marker_frame")
    y, t = F.when(before, F.col("y")), F.when(before, F.col("t"))
    return rows.groupBy(*KEYS).agg(
        F.first("condition").alias("condition"),
        F.when(F.count(y) >= 3, F.regr_slope(y, t)).alias("pre_slope"),
        F.avg(y).alias("pre_mean"),
        F.max(t).alias("pre_duration"),
        F.max(y).alias("pre_peak"),
        F.regr_slope("y", "t").alias("slope"),
        F.avg("y").alias("mean"),
        F.max("t").alias("duration"),
        F.max("y").alias("peak"),
    )


def matrix_sql(cohort: str, source: str, columns: list[str]) -> str:
    parts = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            ranks = f"SELECT grp, {rank_sql('', 'grp', a)} AS ra, {rank_sql('', 'grp', b)} AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(
                f"SELECT '{cohort}' AS cohort, grp, '{a}' AS x_name, '{b}' AS y_name, count(*) AS n, "
                f"{sql_round('CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END')} AS rho FROM ({ranks}) GROUP BY grp"
            )
    return " UNION ALL ".join(parts)


@query(
    "correlation_cohorts",
    "T10 A34",
    DESCRIPTORS
    + ", gp AS (SELECT 'pulsed' AS grp, * FROM ds WHERE condition = 'EP'), gw AS (SELECT 'all' AS grp, * FROM ds UNION ALL SELECT condition, * FROM ds) "
    + matrix_sql("before", "gp", PRE)
    + " UNION ALL "
    + matrix_sql("whole", "gw", WHOLE),
)
def correlation_cohorts(spark, sf_dir):
    rows = fit.staged(descriptors(spark, sf_dir))
    pulsed = rows.filter(F.col("condition") == "EP").withColumn("grp", F.lit("pulsed"))
    both = rows.withColumn("grp", F.explode(F.array(F.lit("all"), F.col("condition"))))
    parts = [
        stats.spearman_matrix(part, columns, ["grp"]).withColumn("cohort", F.lit(name))
        for name, part, columns in (("before", pulsed, PRE), ("whole", both, WHOLE))
    ]
    out = parts[0].unionByName(parts[1])
    return out.select("cohort", "grp", "x_name", "y_name", "n", rounded("rho").alias("rho"))


def triples_sql() -> str:
    ranked = ", ".join(f"{rank_sql('', 'bucket', c)} AS r{i}" for i, c in enumerate(("position", "stiffness", "amount")))
    return (
        FITS
        + f""", tp AS (SELECT l_orderkey % 997 AS bucket, l_linenumber AS position, CASE WHEN gate_pass THEN a END AS stiffness, CASE WHEN NOT runaway THEN tau END AS amount FROM gd),
tk AS (SELECT bucket, {ranked} FROM tp WHERE stiffness IS NOT NULL AND amount IS NOT NULL),
tc AS (SELECT bucket, count(*) AS n, {', '.join(f'CASE WHEN count(*) >= 5 AND stddev_pop(r{i}) > 0 AND stddev_pop(r{j}) > 0 THEN corr(r{i}, r{j}) END AS rho_{n}' for n, i, j in (('xy', 0, 1), ('xz', 0, 2), ('yz', 1, 2)))}
  FROM tk GROUP BY bucket)
SELECT bucket, n, {', '.join(f'{sql_round(f"rho_{c}", 5)} AS rho_{c}' for c in ('xy', 'xz', 'yz'))},
  {sql_round('(rho_xy - rho_xz * rho_yz) / nullif(sqrt(greatest((1 - rho_xz * rho_xz) * (1 - rho_yz * rho_yz), 0)), 0)', 4)} AS partial FROM tc"""
    )


@query("position_triples", "T12 F17", triples_sql())
def position_triples(spark, sf_dir):
    """Position, mechanics and uptake of each bucket, values of failed gates blanked; below five rows nothing is said."""
    rows = fit_rows(spark, sf_dir).select(
        (F.col("l_orderkey") % 997).alias("bucket"), F.col("l_linenumber").alias("position"),
        cohorts.blank_unless(F.col("a"), F.col("gate_pass")).alias("stiffness"),
        F.when(~F.col("runaway"), F.col("tau")).alias("amount"),
    )
    out = stats.rank_triples(rows, ["bucket"], "position", "stiffness", "amount")
    return out.select("bucket", "n", *[rounded(f"rho_{c}", 5).alias(f"rho_{c}") for c in ("xy", "xz", "yz")], rounded("partial", 4).alias("partial"))


HALF, STEPS = 240.0, 61
STEP = resample.linear_grid(-HALF, HALF, STEPS)["step"]
LEVELS = [["region"], ["region", "treatment"], ["region", "fate"], ["region", "behaviour"], ["region", "trap"], ["region", "treatment", "fate"]]
DIMS = ["region", "treatment", "fate", "behaviour", "trap"]

LEVELLED = (
    MARKED
    + f""", wh AS (SELECT trace_id, CASE arg_max(channel, frame) WHEN 'purchase' THEN 'ruptured' ELSE 'intact' END AS fate,
  CASE WHEN count(*) FILTER (WHERE y > 0 AND t - marker_t BETWEEN 0 AND 60) < 3 THEN 'unknown'
    WHEN regr_slope(y, t - marker_t) FILTER (WHERE y > 0 AND t - marker_t BETWEEN 0 AND 60) > 0.02 THEN 'Extends'
    WHEN regr_slope(y, t - marker_t) FILTER (WHERE y > 0 AND t - marker_t BETWEEN 0 AND 60) < -0.02 THEN 'Retracts' ELSE 'Stable' END AS behaviour
  FROM mk WHERE condition <> 'ASP' AND marker_t IS NOT NULL GROUP BY trace_id),
ar AS (SELECT mk.trace_id, arm, frame, t - marker_t AS t, y, y * (1 + event_id % 3) / 2 AS y2 FROM mk WHERE condition <> 'ASP' AND t - marker_t BETWEEN -{HALF} AND {HALF}),
rg AS (SELECT trace_id, arm, frame, t, y, 'body' AS region FROM ar UNION ALL SELECT trace_id, arm, frame, t, y2, 'prot' FROM ar),
sg AS (SELECT *, lead(t) OVER w AS t1, lead(y) OVER w AS y1 FROM rg WINDOW w AS (PARTITION BY trace_id, region ORDER BY frame)),
gr AS (SELECT i, -{HALF}::DOUBLE + i * {STEP!r}::DOUBLE AS g FROM range({STEPS}) r(i)),
ip AS (SELECT sg.trace_id, region, arm AS treatment, fate, behaviour, CAST(sg.trace_id % 18 + 1 AS VARCHAR) AS trap, i, g,
  CASE WHEN g <= t OR t1 IS NULL THEN y ELSE y + (y1 - y) / (t1 - t) * (g - t) END AS value FROM sg JOIN gr ON g >= t AND (g < t1 OR (t1 IS NULL AND g = t)) JOIN wh ON wh.trace_id = sg.trace_id)
"""
)


def _sets(extra: str = "") -> str:
    return "GROUPING SETS (" + ", ".join(f"({', '.join([*level, *([extra] if extra else [])])})" for level in LEVELS) + ")"


def _any(name: str) -> str:
    return f"CASE WHEN grouping({name}) = 1 THEN '*' ELSE {name} END AS {name}"


@query(
    "level_ensembles",
    "R11 R14 R8 F4",
    LEVELLED
    + f""", sz AS (SELECT {', '.join(map(_any, DIMS))}, count(DISTINCT trace_id) AS traces FROM ip GROUP BY {_sets()}),
en AS (SELECT {', '.join(map(_any, DIMS))}, i, max(g) AS grid, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n FROM ip GROUP BY {_sets('i')})
SELECT en.region, en.treatment, en.fate, en.behaviour, en.trap, i, {sql_round('grid')} AS grid, {sql_round('mean', 5)} AS mean, {sql_round('sd', 4)} AS sd, n, traces, traces >= 3 AS aggregate_ok
FROM en JOIN sz ON {' AND '.join(f'en.{d} = sz.{d}' for d in DIMS)} WHERE n >= greatest(1, ceil(0.25 * traces))""",
)
def level_ensembles(spark, sf_dir):
    """Mean and SD around the marker by treatment, fate, behaviour, trap and region, from one interpolation."""
    rows = marked(traces(spark, sf_dir)).filter((F.col("condition") != "ASP") & F.col("marker_t").isNotNull())
    rows = fit.staged(rows.withColumn("rel", F.col("t") - F.col("marker_t")))
    kind = fit.marker_slopes(rows, KEYS, "rel", "y", before=120.0, after=60.0).select("trace_id", behaviour_class(F.col("post_slope")).alias("behaviour"))
    last = rows.groupBy("trace_id").agg(F.max_by("channel", "frame").alias("last"))
    kind = kind.join(last, "trace_id").select(
        "trace_id", F.coalesce("behaviour", F.lit("unknown")).alias("behaviour"), F.when(F.col("last") == "purchase", "ruptured").otherwise("intact").alias("fate")
    )
    values = {"body": F.col("y"), "prot": F.col("y") * (1 + F.col("event_id") % 3) / 2}
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("region"), v.alias("v")) for r, v in values.items()]))
    near = rows.filter(F.col("rel").between(-HALF, HALF)).select("trace_id", F.col("arm").alias("treatment"), "frame", "rel", each.alias("_e"))
    near = near.select("trace_id", "treatment", "frame", "rel", "_e.*")
    points = resample.interpolate(near, ["trace_id", "region"], "rel", "v", **resample.linear_grid(-HALF, HALF, STEPS))
    points = points.join(kind, "trace_id").withColumn("trap", (F.col("trace_id") % 18 + 1).cast("string"))
    out = ensembles.level_ensembles(points, ["trace_id", "region"], DIMS, LEVELS)
    return out.select(
        *DIMS, "i", rounded("grid").alias("grid"), rounded("mean", 5).alias("mean"), rounded("sd", 4).alias("sd"), "n", "traces", "aggregate_ok"
    )


FITTED = [fit.POWER_LAW, fit.MONO]


@query(
    "ensemble_fits",
    "G21 G20",
    POINTS_OF_ENSEMBLES
    + "".join(fit_sql(f"m{i}", "pt", m) + assess_sql(f"m{i}", "pt", f"m{i}fit", m.basis) for i, m in enumerate(FITTED))
    + ", lfit AS (SELECT trace_id, 'Linear' AS model, 1.0::DOUBLE AS s1, 1.0::DOUBLE AS s2, 0.0::DOUBLE AS c1, regr_slope(y, t) AS c2, regr_intercept(y, t) AS c3 FROM pt GROUP BY trace_id)"
    + assess_sql("l", "pt", "lfit", "line")
    + ", al AS (SELECT * FROM la" + "".join(f" UNION ALL SELECT * FROM m{i}a" for i in range(len(FITTED))) + ")"
    + f""" SELECT CASE trace_id WHEN 0 THEN '*' ELSE CAST(trace_id AS VARCHAR) END AS trap, model, n, {sql_round('r2', 4)} AS r2, {sql_round('aic', 2)} AS aic,
  row_number() OVER (PARTITION BY trace_id ORDER BY aic) = 1 AS best_aic FROM al""",
)
def ensemble_fits(spark, sf_dir):
    """Models of the ensemble mean of the controls, overall and of each trap position, compared by AIC; pulsed runs are skipped."""
    rows = traces(spark, sf_dir).filter(F.col("condition") == "ASP").withColumn("trap", (F.col("trace_id") % 18 + 1).cast("string"))
    points = resample.interpolate(rows, KEYS, "t", "y", **resample.grid_to_end(rows, "t", start=0.0, step=8.0), hold=True)
    points = points.withColumn("trap", (F.col("trace_id") % 18 + 1).cast("string"))
    means = ensembles.level_ensembles(points, KEYS, ["trap"], [[], ["trap"]])
    lines = fit.staged(means.select("trap", F.col("i").alias("frame"), F.col("grid").alias("t"), F.col("mean").alias("y")))
    scored = fit.fitted(lines, ["trap"], [fit.LINE, *FITTED])
    best = fit.select_model(scored, ["trap"], ["Linear", *(m.name for m in FITTED)], score="aic").select("trap", F.col("model").alias("_best"))
    out = scored.join(best, "trap")
    return out.select("trap", "model", "n", rounded("r2", 4).alias("r2"), rounded("aic", 2).alias("aic"), (F.col("model") == F.col("_best")).alias("best_aic"))


@query(
    "common_traps",
    "F12",
    """
WITH s AS (SELECT *, l_returnflag || l_linestatus AS experiment FROM lineitem WHERE l_suppkey % 4 <> 0),
w AS (SELECT 'AF' AS experiment, [1, 2, 3, 5] AS chosen UNION ALL SELECT 'RF', [2, 3] UNION ALL SELECT 'NO', NULL),
k AS (SELECT s.experiment, l_linenumber AS trap, chosen FROM s LEFT JOIN w ON w.experiment = s.experiment WHERE chosen IS NULL OR list_contains(chosen, l_linenumber)),
c AS (SELECT trap, count(DISTINCT experiment) AS experiments FROM k GROUP BY trap),
o AS (SELECT CASE WHEN count(*) = 1 THEN min(trap) END AS single FROM c WHERE experiments = (SELECT count(DISTINCT experiment) FROM k))
SELECT trap, experiments, experiments = (SELECT count(DISTINCT experiment) FROM k) AS common, (SELECT single FROM o) AS single,
  (SELECT count(*) FROM k WHERE k.trap = c.trap) AS n_rows FROM c
""",
)
def common_traps(spark, sf_dir):
    """Traps that all experiments kept under their selections, and the only one if there is one."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") % 4 != 0)
    rows = rows.select(F.concat("l_returnflag", "l_linestatus").alias("experiment"), F.col("l_linenumber").alias("trap"))
    chosen = spark.createDataFrame([("AF", [1, 2, 3, 5]), ("RF", [2, 3]), ("NO", None)], "experiment string, chosen array<int>")
    kept = cohorts.selected_traps(rows, chosen, ["experiment"], "trap", "chosen")
    found = cohorts.common_traps(kept, ["experiment"], "trap")
    only = cohorts.single_common_trap(kept, ["experiment"], "trap").scalar()
    return found.join(kept.groupBy("trap").agg(F.count(F.lit(1)).alias("n_rows")), "trap").withColumn("single", only)
