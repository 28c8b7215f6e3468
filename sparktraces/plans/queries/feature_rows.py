"""The feature table: every descriptor of a trace in one row, and its twin put together from the twins of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.operators import features
from sparktraces.plans.bindings import KEYS, MARKED, marked, traces
from sparktraces.plans.queries import fitting
from sparktraces.plans.queries.fitting import C, LONG_ENOUGH, RISE_AMPLITUDE, RISE_TAU, RISING, RP, creep_sql, line_power_sql, rise_sql
from sparktraces.plans.queries.ordered import CLEAN
from sparktraces.plans.registry import query, rounded, sql_round

REGIONS = {"body": "y", "prot": "y * (1 + event_id % 3) / 2", "total": "y + y * (1 + event_id % 3) / 2"}
CREEP_SHOWN = {"model": "model", "e": "e", "e1": "e1", "eta1": "eta1", "eta2": "eta2", "tau": "s1", "r2": "r2", "aicc": "aicc"}


def _wrapped(name: str, ctes: str, select: str) -> str:
    """A chain of CTEs that begins with a comma, as one CTE of its own."""
    return f", {name} AS (WITH {ctes.strip().removeprefix(',')} {select})"


# Each window of a trace is a trace of its own: 3 * trace_id + 0 long, 1 matched, 2 whole.
WINDOWS = """
, sp AS (SELECT trace_id, condition, arm, count(*) AS rows, max(t) - min(t) AS duration, max(marker_frame) AS marker,
  max(CASE WHEN frame = marker_frame THEN t END) - min(t) AS pre_duration FROM mk GROUP BY trace_id, condition, arm),
wm AS (SELECT condition, arm, quantile_cont(duration, 0.5) AS m FROM sp WHERE rows >= 15 GROUP BY ALL),
wp AS (SELECT arm, quantile_cont(pre_duration, 0.5) AS p FROM sp WHERE rows >= 15 AND condition = 'EP' AND marker >= 15 GROUP BY arm),
wk AS (SELECT min(m) FILTER (WHERE condition = 'ASP') AS control_window, (SELECT min(p) FROM wp) AS pre_window FROM wm),
wi AS (SELECT 3 * trace_id AS trace_id, event_id, frame, t, y FROM mk, wk WHERE condition = 'ASP' AND coalesce(t <= control_window, true)
  UNION ALL SELECT 3 * trace_id + 1, event_id, frame, t, y FROM mk, wk WHERE (condition = 'ASP' AND coalesce(t <= pre_window, true))
    OR (condition <> 'ASP' AND y > 0 AND t < marker_t AND coalesce(t - marker_t >= -pre_window, true))
  UNION ALL SELECT 3 * trace_id + 2, event_id, frame, t, y FROM mk),
ok AS (SELECT trace_id, event_id, t, y, row_number() OVER (PARTITION BY trace_id ORDER BY frame) - 1 AS frame, count(*) OVER (PARTITION BY trace_id) AS n FROM wi)
"""


def _creep_columns(code: int, prefix: str) -> str:
    at = f"FILTER (WHERE trace_id % 3 = {code})"
    shown = [f"any_value(model) {at} AS {prefix}model"]
    shown += [f"any_value({sql_round(value, 3)}) {at} AS {prefix}{name}" for name, value in CREEP_SHOWN.items() if name != "model"]
    return ", ".join([*shown, f"any_value(r2 >= 0.85) {at} AS {prefix}r2_flag"])


def _growth(table: str, column: str) -> str:
    return f"(SELECT {sql_round(column, 3)} FROM {table} x WHERE x.trace_id = w.trace_id)"


FEATURES = (
    MARKED
    + WINDOWS
    + CLEAN
    + LONG_ENOUGH
    + ", ptc AS (SELECT * FROM pt WHERE trace_id % 3 < 2), ptw AS (SELECT * FROM pt WHERE trace_id % 3 = 2)"
    + _wrapped("creep", creep_sql("ptc"), f"SELECT trace_id // 3 AS trace_id, {_creep_columns(0, '')}, {_creep_columns(1, 'prepulse_')} FROM wn WHERE pick = 1 GROUP BY 1")
    + _wrapped(
        "growth",
        line_power_sql("ptw"),
        f"""SELECT trace_id // 3 AS trace_id, model AS mi_whole_best_model, {_growth('la', 'c2')} AS mi_whole_linear_slope, {_growth('la', 'c3')} AS mi_whole_linear_intercept,
  {_growth('la', 'r2')} AS mi_whole_linear_r2, {_growth('pa', 's1')} AS mi_whole_pl_b, {_growth('pa', 'r2')} AS mi_whole_pl_r2, n AS mi_whole_n_points, r2 AS winner_r2 FROM win w WHERE pick = 1""",
    )
    + ", spans AS (SELECT trace_id // 3 AS trace_id, "
    + ", ".join(f"{sql_round(f'max(t) FILTER (WHERE trace_id % 3 = {i}) - min(t) FILTER (WHERE trace_id % 3 = {i})')} AS {name}" for i, name in enumerate(("window_duration", "prepulse_window_duration", "mi_whole_window_duration")))
    + " FROM pt GROUP BY 1)"
    + """, slopes AS (SELECT trace_id,
  CASE WHEN count(*) FILTER (WHERE y > 0 AND rel BETWEEN -120 AND 0) >= 3 THEN regr_slope(y, rel) FILTER (WHERE y > 0 AND rel BETWEEN -120 AND 0) END AS pre,
  CASE WHEN count(*) FILTER (WHERE y > 0 AND rel BETWEEN 0 AND 60) >= 3 THEN regr_slope(y, rel) FILTER (WHERE y > 0 AND rel BETWEEN 0 AND 60) END AS post
  FROM (SELECT trace_id, y, t - marker_t AS rel FROM mk WHERE condition <> 'ASP' AND marker_t IS NOT NULL) GROUP BY trace_id)"""
    + f""", sized AS (SELECT trace_id, any_value(condition) AS condition, any_value(arm) AS arm, {sql_round('quantile_cont(y, 0.5) FILTER (WHERE frame < stop AND frame >= stop - 10)', 3)} AS y_before,
  {sql_round('max(y) FILTER (WHERE y > 0 AND frame < stop)', 3)} AS max_before
  FROM (SELECT *, CASE WHEN marker_frame > 0 AND marker_frame < n_rows THEN marker_frame ELSE n_rows END AS stop FROM mk) GROUP BY trace_id)"""
    + ", actin AS (SELECT trace_id, "
    + ", ".join(
        f"""{sql_round(f'arg_min({v}, frame) FILTER (WHERE {v} > 0)', 3)} AS f0_{r},
  {sql_round(f'avg({v}) FILTER (WHERE {v} > 0 AND (NOT pulsed OR frame < marker_frame)) / arg_min({v}, frame) FILTER (WHERE {v} > 0)', 3)} AS actin_{r}_prepulse_f0norm,
  {sql_round(f'avg({v}) FILTER (WHERE {v} > 0 AND pulsed AND frame >= marker_frame) / arg_min({v}, frame) FILTER (WHERE {v} > 0)', 3)} AS actin_{r}_postpulse_f0norm"""
        for r, v in list(REGIONS.items())[:2]
    )
    + " FROM (SELECT *, coalesce(condition = 'EP' AND marker_frame > 0 AND marker_frame < n_rows, false) AS pulsed FROM mk) GROUP BY trace_id)"
    # the regions of the uptake are traces of their own, too
    + _wrapped(
        "uptake",
        ", al AS ("
        + " UNION ALL ".join(f"SELECT 3 * trace_id + {i} AS trace_id, frame, t - marker_t AS rel, {v} AS y FROM mk WHERE condition <> 'ASP' AND marker_t IS NOT NULL" for i, v in enumerate(REGIONS.values()))
        + ")"
        + RISING
        + rise_sql("pt"),
        "SELECT trace_id // 3 AS trace_id, "
        + ", ".join(
            f"any_value(model) FILTER (WHERE trace_id % 3 = {i}) AS uptake_{r}_best_model, any_value({sql_round(RISE_AMPLITUDE, 2)}) FILTER (WHERE trace_id % 3 = {i}) AS uptake_{r}_a, "
            f"any_value({sql_round(RISE_TAU, 2)}) FILTER (WHERE trace_id % 3 = {i}) AS uptake_{r}_tau, any_value({sql_round('r2', 3)}) FILTER (WHERE trace_id % 3 = {i}) AS uptake_{r}_r2, "
            f"any_value({sql_round('(SELECT aicc FROM onea x WHERE x.trace_id = w.trace_id)', 2)}) FILTER (WHERE trace_id % 3 = {i}) AS uptake_{r}_mono_aicc"
            for i, r in enumerate(REGIONS)
        )
        + " FROM wn w WHERE pick = 1 GROUP BY 1",
    )
    + f"""
SELECT sized.*, creep.* EXCLUDE (trace_id), growth.* EXCLUDE (trace_id, winner_r2), CASE condition WHEN 'ASP' THEN winner_r2 >= 0.85 ELSE winner_r2 >= 0.8 END AS mi_whole_r2_flag,
  spans.* EXCLUDE (trace_id), {sql_round('pre', 3)} AS pre_slope, {sql_round('post', 3)} AS post_slope,
  CASE WHEN post > 0.02 THEN 'Extends' WHEN post < -0.02 THEN 'Retracts' WHEN post IS NOT NULL THEN 'Stable' END AS behaviour, actin.* EXCLUDE (trace_id), uptake.* EXCLUDE (trace_id)
FROM sized LEFT JOIN creep ON creep.trace_id = sized.trace_id LEFT JOIN growth ON growth.trace_id = sized.trace_id LEFT JOIN spans ON spans.trace_id = sized.trace_id
LEFT JOIN slopes ON slopes.trace_id = sized.trace_id LEFT JOIN actin ON actin.trace_id = sized.trace_id LEFT JOIN uptake ON uptake.trace_id = sized.trace_id
"""
)

DIGITS = {"a": 2, "tau": 2, "mono_aicc": 2}


@query("feature_table", "G18 G23 A12 J13 A18 A19 A20 G2", FEATURES)
def feature_table(spark, sf_dir):
    """All features of every trace; windows come from the data."""
    rows = marked(traces(spark, sf_dir))
    for region, value in REGIONS.items():
        rows = rows.withColumn(region, F.expr(value))
    out = features.feature_table(
        rows, KEYS, t="t", y="y", condition="condition", marker="marker_frame", marker_t="marker_t", radius_pressure=RP, c=C,
        groups=["arm"], before=120.0, after=60.0, identity=["arm"],
        uptake={r: r for r in REGIONS}, actin={"body": ("body", "body"), "prot": ("prot", "prot")},
    )
    shown = ["trace_id", "condition", "arm", "y_before", "max_before"]
    shown += [f"{p}{c}" for p in ("", "prepulse_") for c in (*CREEP_SHOWN, "r2_flag", "window_duration")]
    shown += [f"mi_whole_{c}" for c in ("best_model", "linear_slope", "linear_intercept", "linear_r2", "pl_b", "pl_r2", "n_points", "r2_flag", "window_duration")]
    shown += ["pre_slope", "post_slope", "behaviour", "f0_body", "f0_prot"]
    shown += [f"actin_{r}_{p}pulse_f0norm" for r in ("body", "prot") for p in ("pre", "post")]
    shown += [f"uptake_{r}_{c}" for r in REGIONS for c in ("best_model", "a", "tau", "r2", "mono_aicc")]
    numbers = {f.name for f in out.schema.fields if f.dataType.typeName() == "double"}
    digits = lambda name: 6 if name.endswith("duration") else 2 if name.startswith("uptake") and not name.endswith("r2") else 3
    return out.select(*[rounded(n, digits(n)).alias(n) if n in numbers else n for n in shown])
