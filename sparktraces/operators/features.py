"""The per-trace feature table: one row per trace, a failed part is NULL.

The rows of a trace enter its windows (long, matched, whole) under a window name beside the keys. From there on one
chain cleans, numbers and fits all windows together, and one aggregation lays the results out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraces.functions.physics import behaviour_class, winner_value
from sparktraces.operators import fit, summaries
from sparktraces.operators.sequence import renumber, summarise
from sparktraces.operators.stage import staged

CREEP_COLUMNS = ["model", "e", "e1", "eta1", "eta2", "tau", "r2", "aicc", "dw"]
#: Column prefix of each window.
PREFIXES = {"long": "", "matched": "prepulse_", "whole": "mi_whole_"}
RISE_COLUMNS = {"model": "best_model", "amplitude": "a", "tau": "tau", "r2": "r2", "r2_flag": "r2_flag", "a1": "a1", "tau1": "tau1", "a2": "a2", "tau2": "tau2", "mono_aicc": "mono_aicc", "bi_aicc": "bi_aicc"}


def _wide(df: DataFrame, keys: Sequence[str], by: str, columns: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One row per trace: for each value of ``by`` the named columns of its row, under the names given."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(by) == value, F.col(c))).alias(name) for value, names in columns.items() for c, name in names.items()]
    )


def windows(rows: DataFrame, keys: Sequence[str], groups: Sequence[str], *, t: str, condition: str, marker: str) -> DataFrame:
    """One row with the durations of the windows, from the table itself."""
    spans = summaries.trace_spans(rows, keys, list(dict.fromkeys([condition, *groups])), t, marker)
    return summaries.window_constants(spans, groups, condition)


def window_points(
    rows: DataFrame, keys: Sequence[str], *, t: str, y: str, condition: str, marker_t: str, durations: Column, min_points: int
) -> DataFrame:
    """Outlier-free points of all windows: (keys, window, frame, t, y).

    Controls enter the long window; controls, and pulsed traces before the marker where they are positive, the matched one; all
    rows the whole one. A window without a duration has no end.
    """
    control = F.col(condition) == "ASP"

    def within(time: Column, duration: Column) -> Column:
        return F.coalesce(time <= duration, F.lit(True))

    to_marker = F.col(marker_t) - F.col(t)
    long = control & within(F.col(t), F.col("_d.control_window"))
    matched = (control & within(F.col(t), F.col("_d.pre_window"))) | (
        ~control & (F.col(y) > 0) & (to_marker > 0) & within(to_marker, F.col("_d.pre_window"))
    )
    names = F.array_compact(F.array(F.when(long, F.lit("long")), F.when(matched, F.lit("matched")), F.lit("whole")))
    present = rows.filter(F.col(t).isNotNull() & F.col(y).isNotNull()).withColumn("_d", durations)
    by = [*keys, "window"]
    tagged = present.select(*keys, "frame", F.col(t).alias("_t"), F.col(y).alias("_y"), F.explode(names).alias("window"))
    dense = renumber(tagged, by, n_rows="_rows")
    return fit.fit_points(dense, by, "_t", "_y", n_rows="_rows", min_points=min_points)


def window_features(
    points: DataFrame, keys: Sequence[str], radius_pressure: float, c: float, *, r2_floor: float, condition: DataFrame, growth_floors: tuple[float, float]
) -> DataFrame:
    """Creep fits of the long and matched windows, line and power law of the whole one, from one pass over their points.

    ``condition`` gives (keys, _control); the floors of the whole window are those of controls and of pulsed traces.
    """
    by = [*keys, "window"]
    creep = fit.viscoelastic_models(radius_pressure, c)
    scored = fit.fitted(points, by, {"long": creep, "matched": creep, "whole": [fit.LINE, fit.POWER_LAW]}, by="window")
    crept = F.col("window") != "whole"
    best = fit.viscoelastic_winners(points.filter(crept), by, scored.filter(crept), radius_pressure, c).filter("selected")
    best = best.withColumn("r2_flag", F.col("r2") >= r2_floor)
    creep_wide = _wide(best, keys, "window", {w: {x: f"{PREFIXES[w]}{x}" for x in [*CREEP_COLUMNS, "r2_flag"]} for w in ("long", "matched")})

    whole = fit.line_or_power_winners(by, scored.filter(~crept))

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    p = PREFIXES["whole"]
    growth = whole.groupBy(*keys).agg(
        F.max(F.when(F.col("selected"), F.col("model"))).alias(f"{p}best_model"),
        *[of("Linear", x).alias(f"{p}linear_{n}") for x, n in (("c2", "slope"), ("c3", "intercept"), ("r2", "r2"), ("aicc", "aicc"))],
        *[of("Power-Law", x).alias(f"{p}pl_{n}") for x, n in (("c1", "a"), ("s1", "b"), ("c3", "c"), ("r2", "r2"), ("aicc", "aicc"))],
    )
    winner_r2 = winner_value(F.col(f"{p}best_model"), F.col(f"{p}linear_r2"), F.col(f"{p}pl_r2"))
    floor = F.when(F.col("_control"), growth_floors[0]).otherwise(growth_floors[1])
    growth = growth.join(condition, list(keys)).withColumn(f"{p}r2_flag", winner_r2 >= floor).drop("_control")
    spans = points.groupBy(*by).agg((F.max("t") - F.min("t")).alias("d"), F.count(F.lit(1)).alias("n"))
    spans = _wide(spans, keys, "window", {w: {"d": f"{q}window_duration", "n": f"{q}n_points"} for w, q in PREFIXES.items()})
    return spans.join(creep_wide, list(keys), "left").join(growth, list(keys), "left")


def uptake_features(rows: DataFrame, keys: Sequence[str], rel_t: str, regions: Mapping[str, str]) -> DataFrame:
    """Rise fits after the marker of every region, all regions in one pass."""
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("region"), F.col(v).cast("double").alias("value")) for r, v in regions.items()]))
    by = [*keys, "region"]
    each = rows.select(*keys, "frame", rel_t, values.alias("_v")).select(*keys, "frame", rel_t, "_v.*")
    fits = fit.fit_rises(fit.rise_points(each, by, rel_t, "value"), by)
    return _wide(fits, keys, "region", {r: {x: f"uptake_{r}_{n}" for x, n in RISE_COLUMNS.items()} for r in regions})


def feature_table(
    df: DataFrame, keys: Sequence[str], *, t: str, y: str, condition: str, marker: str, marker_t: str,
    radius_pressure: float, c: float, groups: Sequence[str], r2_floor: float = 0.85, growth_floors: tuple[float, float] = (0.85, 0.80),
    before: float = 5.0, after: float = 2.0, min_points: int = fit.MIN_POINTS, identity: Sequence[str] = (),
    uptake: Mapping[str, str] | None = None, actin: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per trace from rows with a dense ``frame``.

    Creep fits over a long window (controls) and over a window matched between controls and the time before the marker of
    pulsed traces, whose durations are the least medians over ``groups``; line and power-law fits of the whole trace; slopes
    around the marker; size and maximum before it; rises after it for the regions of ``uptake``; means over the baseline for
    those of ``actin``, which names a value and a baseline column for each.
    """
    keys = list(keys)
    rows = staged(df)
    control = F.col(condition) == "ASP"
    one = windows(rows, keys, groups, t=t, condition=condition, marker=marker)
    durations = one.select(F.struct("control_window", "pre_window")).scalar()
    points = window_points(rows, keys, t=t, y=y, condition=condition, marker_t=marker_t, durations=durations, min_points=min_points)
    kind = rows.groupBy(*keys).agg(F.max(control).alias("_control"))
    parts = [window_features(points, keys, radius_pressure, c, r2_floor=r2_floor, condition=kind, growth_floors=growth_floors)]

    pulsed = rows.filter(~control & F.col(marker_t).isNotNull()).withColumn("_rel", F.col(t) - F.col(marker_t))
    slopes = fit.marker_slopes(pulsed, keys, "_rel", y, before=before, after=after)
    parts.append(slopes.withColumn("behaviour", behaviour_class(F.col("post_slope"))))
    parts.append(summaries.last_before_marker(rows, keys, marker, [y], n_rows="n_rows"))
    if uptake:
        parts.append(uptake_features(pulsed, keys, "_rel", uptake))
    for region, (value, baseline) in (actin or {}).items():
        norm = summaries.pre_post_over_baseline(rows, keys, value, baseline, marker, condition, n_rows="n_rows")
        parts.append(
            norm.select(
                *keys, F.col("f0").alias(f"f0_{region}"), F.col("pre_norm").alias(f"actin_{region}_prepulse_f0norm"),
                F.col("post_norm").alias(f"actin_{region}_postpulse_f0norm"),
            )
        )
    valid = (F.col(marker) > 0) & (F.col(marker) < F.col("n_rows"))
    until = F.when(valid, F.col(marker)).otherwise(F.col("n_rows"))
    out = summarise(
        rows, keys, F.max(F.when((F.col(y) > 0) & (F.col("frame") < until), F.col(y))).alias("max_before"),
        *[F.first(i).alias(i) for i in [condition, *identity]],
    ).drop("_last")
    for part in parts:
        out = out.join(part, keys, "left")
    return out
