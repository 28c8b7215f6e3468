"""Interpolation of traces on common grids and the ensembles built from them.

No range join is needed: the span between two samples computes which grid points
it covers and emits just those.  ``frame`` must be dense and times increasing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraces.operators.quantiles import quantiles
from sparktraces.operators.sequence import attach, rolling, summarise


def linear_grid(lo: float, hi: float, points: int) -> dict[str, float]:
    """Start, step and count of an evenly spaced grid that includes both ends."""
    return {"start": lo, "step": (hi - lo) / (points - 1), "points": points}


def grid_to_end(df: DataFrame, t: str, *, start: float, step: float) -> dict[str, float | Column]:
    """A grid from ``start`` by ``step`` to the first point at or past the last time of the table.

    The count is part of the plan: one row that Spark works out when the grid is used.
    """
    end = F.coalesce(F.ceil((F.max(t) - start) / step) + 1, F.lit(1))
    return {"start": start, "step": step, "points": df.agg(F.greatest(F.lit(1), end).cast("long").alias("points")).scalar()}


def grid_over(df: DataFrame, t: str, points: int) -> dict[str, float | Column]:
    """An evenly spaced grid from 0 to the last time of the table."""
    end = F.coalesce(F.nullif(F.max(t), F.lit(0.0)), F.lit(1.0))
    return {"start": 0.0, "step": df.agg((end / (points - 1)).alias("step")).scalar(), "points": points}


def end_percentile(df: DataFrame, keys: Sequence[str], groups: Sequence[str], t: str, *, q: float = 0.95) -> DataFrame:
    """Per group the percentile of the last times of its traces, and the number of traces."""
    ends = df.groupBy(*keys, *groups).agg(F.max(t).alias("_end"))
    counts = ends.groupBy(*groups).agg(F.count(F.lit(1)).alias("traces"))
    return quantiles(ends, list(groups), "_end", {"cap": q}).join(counts, list(groups))


def mean_step_grid(df: DataFrame, keys: Sequence[str], bucket: Sequence[str], t: str, *, frame: str = "frame") -> DataFrame:
    """Per bucket: mean time step, last time, and the number of grid points from 0 past the end."""
    stepped = rolling(df, keys, {"_dt": lambda w: F.col(t) - F.lag(t).over(w)}, before=1, frame=frame)
    return (
        stepped.groupBy(*bucket)
        .agg(F.avg("_dt").alias("step"), F.max(t).alias("end"))
        .withColumn("points", F.ceil((F.col("end") + F.col("step")) / F.col("step")).cast("long"))
    )


def _column(value: Column | float | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _spans(df: DataFrame, keys: Sequence[str], t: str, y: str, frame: str) -> DataFrame:
    return rolling(
        df,
        keys,
        {
            "_t1": lambda w: F.lead(t).over(w),
            "_y1": lambda w: F.lead(y).over(w),
            "_head": lambda w: F.lag(t).over(w).isNull(),
        },
        before=1,
        after=1,
        frame=frame,
    )


def _emit(spans: DataFrame, t: str, start, step, points, hold: bool, index: str, grid: str) -> DataFrame:
    """Rows of ``spans`` once per grid point they answer for."""
    # a grid that is worked out by the plan becomes columns first: a generator takes no subquery
    spans = spans.withColumns({"_start": _column(start), "_step": _column(step), "_points": _column(points).cast("long")})
    start, step, points = F.col("_start"), F.col("_step"), F.col("_points")
    t0, t1 = F.col(t), F.col("_t1")
    lo = F.floor((t0 - start) / step) - 1
    hi = F.ceil((F.coalesce(t1, t0) - start) / step) + 1
    if hold:
        lo = F.when(F.col("_head"), F.lit(0)).otherwise(lo)
        hi = F.when(t1.isNull(), points).otherwise(hi)
    lo, hi = F.greatest(lo, F.lit(0)).cast("long"), F.least(hi, points - 1).cast("long")
    out = spans.withColumn(index, F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).withColumn(
        grid, start + F.col(index) * step
    )
    g = F.col(grid)
    inside = (g >= t0) & ((g < t1) | (t1.isNull() & (g == t0)))
    if hold:
        inside = inside | (F.col("_head") & (g < t0)) | (t1.isNull() & (g > t0))
    return out.filter(inside).drop("_start", "_step", "_points")


def interpolate(
    df: DataFrame, keys: Sequence[str], t: str, y: str, *, start, step, points, hold: bool = False,
    index: str = "i", grid: str = "grid", out: str = "value", frame: str = "frame",
) -> DataFrame:
    """Linear interpolation at ``start + i * step`` for i below ``points``.

    Grid points outside a trace are absent, or repeat its end values with ``hold``.
    The grid may differ per row (columns of the bucket).
    """
    placed = _emit(_spans(df, keys, t, y, frame), t, start, step, points, hold, index, grid)
    g, t0, y0 = F.col(grid), F.col(t), F.col(y)
    slope = (F.col("_y1") - y0) / (F.col("_t1") - t0)
    value = F.when((g <= t0) | F.col("_t1").isNull(), y0).otherwise(y0 + slope * (g - t0))
    return placed.withColumn(out, value).drop("_t1", "_y1", "_head", t, y, frame)


def interpolate_pchip(
    df: DataFrame, keys: Sequence[str], t: str, y: str, *, start, step, points,
    index: str = "i", grid: str = "grid", out: str = "value", frame: str = "frame",
) -> DataFrame:
    """Monotone cubic interpolation (Fritsch-Carlson slopes) inside each trace's range."""
    h, m = F.col("_h"), F.col("_m")

    def end_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
        raw = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        return (
            F.when(F.signum(raw) != F.signum(m0), F.lit(0.0))
            .when((F.signum(m0) != F.signum(m1)) & (F.abs(raw) > 3 * F.abs(m0)), 3 * m0)
            .otherwise(raw)
        )

    def slope(w) -> Column:
        hb, mb = F.lag("_h").over(w), F.lag("_m").over(w)
        w1, w2 = 2 * h + hb, h + 2 * hb
        inner = F.when((mb * m) <= 0, F.lit(0.0)).otherwise(
            (w1 + w2) / (w1 / F.nullif(mb, F.lit(0.0)) + w2 / F.nullif(m, F.lit(0.0)))
        )
        first = F.coalesce(end_slope(h, F.lead("_h").over(w), m, F.lead("_m").over(w)), m)
        last = F.coalesce(end_slope(hb, F.lag("_h", 2).over(w), mb, F.lag("_m", 2).over(w)), mb)
        return F.when(mb.isNull(), first).when(m.isNull(), last).otherwise(inner)

    spans = rolling(
        df,
        keys,
        {
            "_t1": lambda w: F.lead(t).over(w),
            "_y1": lambda w: F.lead(y).over(w),
            "_head": lambda w: F.lag(t).over(w).isNull(),
            "_h": lambda w: F.col("_t1") - F.col(t),
            "_m": lambda w: (F.col("_y1") - F.col(y)) / F.col("_h"),
            "_d": slope,
            "_d1": lambda w: F.lead("_d").over(w),
        },
        before=3,
        after=3,
        frame=frame,
    )
    placed = _emit(spans, t, start, step, points, False, index, grid)
    s = (F.col(grid) - F.col(t)) / h
    y0, y1, d0, d1 = F.col(y), F.col("_y1"), F.col("_d"), F.col("_d1")
    value = (
        y0 * (1 + 2 * s) * (1 - s) * (1 - s)
        + d0 * h * s * (1 - s) * (1 - s)
        + y1 * s * s * (3 - 2 * s)
        + d1 * h * s * s * (s - 1)
    )
    return placed.withColumn(out, F.when(F.col("_t1").isNull(), y0).otherwise(value)).drop(
        "_t1", "_y1", "_head", "_h", "_m", "_d", "_d1", t, y, frame
    )


def bucket_sizes(traces: DataFrame, keys: Sequence[str], bucket: Sequence[str]) -> DataFrame:
    """Number of traces per bucket."""
    return traces.groupBy(*bucket, *[k for k in keys if k not in bucket]).agg(F.lit(1).alias("_one")).groupBy(*bucket).agg(
        F.count(F.lit(1)).alias("traces")
    )


def needed(traces: Column, share: float, rule: str) -> Column:
    """Smallest contributing count that keeps a grid point: max(1, ceil or floor of share * traces)."""
    amount = traces * F.lit(share)
    return F.greatest(F.lit(1), F.ceil(amount) if rule == "ceil" else F.floor(amount))


def ensemble_mean(
    points: DataFrame, sizes: DataFrame, bucket: Sequence[str], *, value: str = "value", index: str = "i",
    grid: str = "grid", share: float = 0.25, rule: str = "ceil", min_traces: int = 3,
) -> DataFrame:
    """Mean, population SD, SEM and count per bucket and grid point, where enough traces contribute.

    ``aggregate_ok`` is false for buckets with fewer than ``min_traces`` traces.
    """
    sd = F.stddev_pop(value)
    return (
        points.groupBy(*bucket, index)
        .agg(
            F.max(grid).alias(grid),
            F.avg(value).alias("mean"),
            sd.alias("sd"),
            (sd / F.sqrt(F.count(value))).alias("sem"),
            F.count(value).alias("n"),
        )
        .join(sizes, list(bucket))
        .filter(F.col("n") >= needed(F.col("traces"), share, rule))
        .withColumn("aggregate_ok", F.col("traces") >= min_traces)
    )


def ensemble_quartiles(
    points: DataFrame, sizes: DataFrame, bucket: Sequence[str], *, value: str = "value", index: str = "i",
    share: float = 0.25, rule: str = "floor",
) -> DataFrame:
    """Median, quartiles and count per bucket and grid point, where enough traces contribute."""
    probs = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return (
        quantiles(points, [*bucket, index], value, probs, count="n")
        .join(sizes, list(bucket))
        .filter(F.col("n") >= needed(F.col("traces"), share, rule))
    )


def value_at(
    df: DataFrame, keys: Sequence[str], t: str, y: str, at: float, *, min_rows: int = 5,
    baseline: Column | None = None, frame: str = "frame",
) -> DataFrame:
    """(trace, status, value): linear reading at one time, never past the end of the record.

    status is found, short_record or no_trace (fewer than ``min_rows`` rows from time 0 on).
    """
    after = df.filter(F.col(t).isNotNull() & F.col(y).isNotNull() & (F.col(t) >= 0))
    known = summarise(
        after,
        keys,
        F.count(F.lit(1)).alias("_n"),
        F.max(t).alias("_end"),
        F.min_by(y, t).alias("_y_first"),
        F.min(t).alias("_t_first"),
        frame=frame,
    )
    read = interpolate(after.select(*keys, frame, t, y), keys, t, y, start=float(at), step=1.0, points=1, frame=frame)
    base = df.groupBy(*keys).agg((baseline if baseline is not None else F.lit(0.0)).alias("_base"))
    enough = F.coalesce(F.col("_n") >= min_rows, F.lit(False))
    status = F.when(~enough, "no_trace").when(F.col("_end") < at, "short_record").otherwise("found")
    # Before the first sample the first value holds, as in an interpolation clamped on the left.
    reading = F.coalesce("value", F.when(F.col("_t_first") > at, F.col("_y_first")))
    return (
        base.join(known, list(keys), "left")
        .join(read.select(*keys, "value"), list(keys), "left")
        .select(*keys, status.alias("status"), F.when(status == "found", reading - F.col("_base")).alias("value"))
    )


def reaching(df: DataFrame, keys: Sequence[str], t: str, cap: float, *, fraction: float = 0.5, frame: str = "frame") -> DataFrame:
    """Traces that last at least ``fraction`` of the cap."""
    ends = summarise(df, keys, F.max(t).alias("_end"), frame=frame).filter(F.col("_end") >= fraction * cap)
    return attach(df, ends, keys, frame=frame, how="inner").drop("_end")


def split_at(df: DataFrame, groups: Sequence[str], t: str, at: float, *, out: str = "part") -> DataFrame:
    """Marks rows before / after the row nearest to a time (that row opens the second part)."""
    nearest = df.groupBy(*groups).agg(F.min(F.struct(F.abs(F.col(t) - at), F.col(t).alias("t"))).alias("_near"))
    return df.join(nearest, list(groups)).withColumn(
        out, F.when(F.col(t) < F.col("_near.t"), "before").otherwise("after")
    ).drop("_near")
