"""Rolling filters, outlier rules and ordered derivatives."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from sparktraces.operators.sequence import attach, rolling, summarise, with_summary

MAD_TO_SIGMA = 1.4826


def rolling_percentile(y: str, p: float, w: WindowSpec) -> Column:
    return F.expr(f"percentile(`{y}`, {p})").over(w)


def median3(df: DataFrame, keys: Sequence[str], y: str, *, n_rows: str, out: str = "smooth", frame: str = "frame") -> DataFrame:
    """Centred 3-row median, shorter at the ends; traces of under 3 rows stay raw."""
    smooth = rolling(
        df, keys, {out: lambda w: rolling_percentile(y, 0.5, w.rowsBetween(-1, 1))}, before=1, after=1, frame=frame
    )
    return smooth.withColumn(out, F.when(F.col(n_rows) < 3, F.col(y)).otherwise(F.col(out)))


def causal_median3(df: DataFrame, keys: Sequence[str], y: str, *, out: str = "smooth", frame: str = "frame") -> DataFrame:
    return rolling(df, keys, {out: lambda w: rolling_percentile(y, 0.5, w.rowsBetween(-2, 0))}, before=2, frame=frame)


def edge_median(y: str, half: int, w: WindowSpec) -> Column:
    """Median of 2*half+1 rows where the first and last value are repeated past the ends."""
    inside = F.collect_list(y).over(w.rowsBetween(-half, half))
    left = F.count(F.lit(1)).over(w.rowsBetween(-half, -1))
    right = F.count(F.lit(1)).over(w.rowsBetween(1, half))
    padded = F.concat(
        F.array_repeat(inside[0], (F.lit(half) - left).cast("int")),
        inside,
        F.array_repeat(F.element_at(inside, -1), (F.lit(half) - right).cast("int")),
    )
    return F.sort_array(padded)[half]


def outlier_free(
    df: DataFrame, keys: Sequence[str], y: str, *, n_rows: str, window: int = 11, n_sigma: float = 2.5,
    floor: float = 0.1, frame: str = "frame", out: str = "inlier",
) -> DataFrame:
    """Flags rows within ``n_sigma`` scaled MADs of the edge-padded rolling median.

    ``frame`` must be dense over non-null values.  Traces shorter than the window keep every row.
    """
    half = window // 2
    flagged = rolling(
        df,
        keys,
        {
            "_med": lambda w: edge_median(y, half, w),
            "_dev": lambda w: F.abs(F.col(y) - F.col("_med")),
            "_mad": lambda w: edge_median("_dev", half, w),
        },
        before=2 * half,
        after=2 * half,
        frame=frame,
    )
    sigma = F.greatest(F.col("_mad") * MAD_TO_SIGMA, F.lit(floor))
    keep = (F.col(n_rows) < window) | (F.col("_dev") <= n_sigma * sigma)
    return flagged.withColumn(out, keep).drop("_med", "_dev", "_mad")


def outlier_free_std(
    df: DataFrame, keys: Sequence[str], y: str, *, n_rows: str, window: int = 11, n_sigma: float = 2.5,
    scale: float = 0.629, frame: str = "frame", out: str = "inlier",
) -> DataFrame:
    """Like `outlier_free` with a rolling sample deviation, floored at half the pixel scale."""
    half = window // 2
    flagged = rolling(
        df,
        keys,
        {
            "_med": lambda w: edge_median(y, half, w),
            "_sd": lambda w: F.coalesce(F.stddev_samp(y).over(w.rowsBetween(-half, half)), F.lit(0.0)),
        },
        before=half,
        after=half,
        frame=frame,
    )
    sd = F.greatest(F.col("_sd"), F.lit(0.5 * scale))
    keep = (F.col(n_rows) <= window) | (F.abs(F.col(y) - F.col("_med")) <= n_sigma * sd)
    return flagged.withColumn(out, keep).drop("_med", "_sd")


def drop_leading(df: DataFrame, *, fraction: float, n_rows: str, frame: str = "frame") -> DataFrame:
    """Drops the first int(n * fraction) rows unless fewer than 6 would remain."""
    cut = F.floor(F.col(n_rows) * F.lit(fraction))
    return df.filter(F.col(frame) >= F.when(cut >= F.col(n_rows) - 5, F.lit(0)).otherwise(cut))


def derivative(df: DataFrame, keys: Sequence[str], t: str, y: str, *, out: str = "rate", frame: str = "frame") -> DataFrame:
    """Backward difference quotient; the first row is missing, a zero time step counts as 1e-6."""
    stepped = rolling(
        df,
        keys,
        {"_pt": lambda w: F.lag(t).over(w), "_py": lambda w: F.lag(y).over(w)},
        before=1,
        frame=frame,
    )
    dt = F.col(t) - F.col("_pt")
    return stepped.withColumn(
        out, (F.col(y) - F.col("_py")) / F.when(dt == 0, F.lit(1e-6)).otherwise(dt)
    ).drop("_pt", "_py")


def polynomial_weights(window: int, order: int) -> list[list[float]]:
    """Row i holds the weights that give a fitted polynomial's value at position i of the window."""
    x = np.vander(np.arange(window) - window // 2, order + 1).astype(float)
    return (x @ np.linalg.pinv(x)).tolist()


def polynomial_smooth(
    df: DataFrame, keys: Sequence[str], y: str, *, n_rows: str, window: int = 9, order: int = 3,
    out: str = "smooth", frame: str = "frame",
) -> DataFrame:
    """Least-squares polynomial smoothing; end rows use the fit of the outermost window."""
    half = window // 2
    rows = F.array(*[F.array(*[F.lit(v) for v in r]) for r in polynomial_weights(window, order)])

    def smooth(w: WindowSpec) -> Column:
        near = F.collect_list(y).over(w.rowsBetween(-2 * half, 2 * half))
        from_end = F.col(n_rows) - 1 - F.col(frame)
        position = (
            F.when(F.col(frame) < half, F.col(frame))
            .when(from_end < half, F.lit(window - 1) - from_end)
            .otherwise(F.lit(half))
            .cast("int")
        )
        start = (
            F.when(F.col(frame) < half, F.lit(1))
            .when(from_end < half, F.size(near) - (window - 1))
            .otherwise(F.least(F.col(frame), F.lit(2 * half)) - half + 1)
            .cast("int")
        )
        terms = F.zip_with(F.get(rows, position), F.slice(near, start, window), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    return rolling(df, keys, {out: smooth}, before=2 * half, after=2 * half, frame=frame)


def velocity_drop(
    df: DataFrame, keys: Sequence[str], t: str, y: str, *, n_rows: str, sensitivity: float = 2.0, frame: str = "frame",
) -> DataFrame:
    """First frame per trace whose smoothed velocity falls below mean - sensitivity * std (>= 10 rows)."""
    smooth = polynomial_smooth(df.filter(F.col(n_rows) >= 10), keys, y, n_rows=n_rows, out="_s", frame=frame)
    moved = rolling(
        smooth,
        keys,
        {"_v": lambda w: (F.col("_s") - F.lag("_s").over(w)) / (F.col(t) - F.lag(t).over(w) + 1e-10)},
        before=1,
        frame=frame,
    )
    limits = summarise(
        moved, keys, (F.avg("_v") - sensitivity * F.stddev_pop("_v")).alias("_limit"), frame=frame
    )
    below = (F.col("_v") < F.col("_limit")) & (F.col(frame) < F.col(n_rows) - 1)
    return (
        attach(moved, limits, keys, frame=frame)
        .groupBy(*keys)
        .agg(
            F.min(F.when(below, F.col(frame))).alias("drop_frame"),
            F.min_by(t, F.when(below, F.col(frame))).alias("drop_t"),
        )
    )


def side_slopes(
    df: DataFrame, keys: Sequence[str], t: str, y: str, *, n_rows: str, fraction: float = 0.33,
    noise: float = 0.3, snr: float = 1.5, plateau: float = 0.5, frame: str = "frame",
) -> DataFrame:
    """Early and late slopes of each trace and whether its late flow stands out of the noise."""
    side = F.greatest(F.lit(5), F.bround(F.col(n_rows) * F.lit(fraction), 0))
    early, late = F.col(frame) < side, F.col(frame) >= F.col(n_rows) - side
    out = df.groupBy(*keys).agg(
        F.max(n_rows).alias("n"),
        (F.max(t) - F.min(t)).alias("duration"),
        F.regr_slope(F.when(early, F.col(y)), F.when(early, F.col(t))).alias("early_slope"),
        F.regr_slope(F.when(late, F.col(y)), F.when(late, F.col(t))).alias("late_slope"),
    )
    usable = (F.col("n") >= 5) & (F.col("duration") > 0)
    late_abs = F.abs(F.coalesce("late_slope", F.lit(0.0)))
    early_abs = F.abs(F.coalesce("early_slope", F.lit(0.0)))
    return out.withColumn("flow_ok", usable & (late_abs * F.col("duration") > snr * noise)).withColumn(
        "plateau_ok", usable & (early_abs >= 1e-9) & (late_abs < plateau * early_abs)
    )


def time_to_fraction(df: DataFrame, keys: Sequence[str], t: str, y: str, *, fraction: float = 0.63, frame: str = "frame") -> DataFrame:
    """Time of the row nearest ``fraction`` of the trace maximum, the earliest on ties."""
    peak = with_summary(df, keys, F.greatest(F.max(y), F.lit(1e-9)).alias("_peak"), frame=frame)
    distance = F.abs(F.col(y) - fraction * F.col("_peak"))
    return peak.groupBy(*keys).agg(
        F.max("_peak").alias("peak"), F.min_by(t, F.struct(distance, F.col(frame))).alias("t_fraction")
    )


def durbin_watson(df: DataFrame, keys: Sequence[str], residual: str, *, frame: str = "frame") -> DataFrame:
    """Sum of squared residual steps over the sum of squares; missing for < 2 rows or no residual."""
    stepped = rolling(df, keys, {"_pe": lambda w: F.lag(residual).over(w)}, before=1, frame=frame)
    step, e = F.col(residual) - F.col("_pe"), F.col(residual)
    return stepped.groupBy(*keys).agg(
        F.count(residual).alias("n"), F.sum(e * e).alias("rss"), F.sum(step * step).alias("_ss")
    ).withColumn("dw", F.when((F.col("n") >= 2) & (F.col("rss") >= 1e-15), F.col("_ss") / F.col("rss"))).drop("_ss")
