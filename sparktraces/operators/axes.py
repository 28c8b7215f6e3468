"""Time axes, marker handling and phase extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraces.operators.sequence import attach, renumber, rolling, summarise, with_summary, without_chunks


def elapsed(df: DataFrame, keys: Sequence[str], t: str, *, out: str = "elapsed", frame: str = "frame") -> DataFrame:
    """Time since the first row of the trace."""
    start = F.min_by(t, frame).alias("_t0")
    return with_summary(df, keys, start, frame=frame).withColumn(out, F.col(t) - F.col("_t0")).drop("_t0")


def marker_time(df: DataFrame, keys: Sequence[str], t: str, marker: str, *, out: str = "marker_t", frame: str = "frame") -> DataFrame:
    """Time at the marker frame of the trace; NULL when the marker lies outside it."""
    hit = F.max(F.when(F.col(frame) == F.col(marker), F.col(t))).alias(out)
    return with_summary(df, keys, hit, frame=frame)


def marker_relative(t: Column, marker_t: Column, condition: Column) -> Column:
    """Time from the marker; missing for controls and for markers outside the trace."""
    return F.when(condition != "ASP", t - marker_t)


def since_entry(
    df: DataFrame, keys: Sequence[str], t: str, y: str, *, drop_earlier: bool = False,
    out: str = "entry_t", frame: str = "frame",
) -> DataFrame:
    """Time from the first row with a positive value; earlier rows are negative, or dropped."""
    start = F.min(F.when(F.col(y) > 0, F.col(t))).alias("_te")
    rows = with_summary(df, keys, start, frame=frame).withColumn(out, F.col(t) - F.col("_te")).drop("_te")
    return rows.filter(F.col(out) >= 0) if drop_earlier else rows


def shift_to_start(
    df: DataFrame, keys: Sequence[str], t: str, y: str, *, threshold: float = 0.1,
    out: str = "start_t", frame: str = "frame",
) -> DataFrame:
    """Rows from the first one that, with its successor, exceeds the threshold; row 0 when none does."""
    both = rolling(df, keys, {"_next": lambda w: F.lead(y).over(w)}, after=1, frame=frame)
    hit = (F.col(y) > threshold) & (F.col("_next") > threshold)
    marks = summarise(
        both,
        keys,
        F.coalesce(F.min(F.when(hit, F.col(frame))), F.min(frame)).alias("_s"),
        F.coalesce(F.min_by(t, F.when(hit, F.col(frame))), F.min_by(t, frame)).alias("_ts"),
        frame=frame,
    )
    return (
        attach(both, marks, keys, frame=frame)
        .filter(F.col(frame) >= F.col("_s"))
        .withColumn(out, F.col(t) - F.col("_ts"))
        .drop("_next", "_s", "_ts")
    )


def until_event(df: DataFrame, frame: str, event: str) -> DataFrame:
    """Rows up to and including the event; all rows when there is no event."""
    return df.filter(F.col(event).isNull() | (F.col(frame) <= F.col(event)))


def marker_flag(frame: Column, marker: Column, blank: int) -> Column:
    """True on the rows from one before the marker to ``blank`` after it."""
    return F.coalesce(frame.between(marker - 1, marker + blank), F.lit(False))


def active_only(value: Column, frame: Column, entry: Column, exit_: Column) -> Column:
    """Value inside [entry, exit], NULL outside."""
    return F.when(frame.between(entry, exit_), value)


def rebase(df: DataFrame, keys: Sequence[str], t: str, y: str, *, frame: str = "frame") -> DataFrame:
    """Time and value relative to the first row, negative values clipped to 0."""
    first = with_summary(df, keys, F.min_by(t, frame).alias("_t0"), F.min_by(y, frame).alias("_y0"), frame=frame)
    return (
        first.withColumn(t, F.col(t) - F.col("_t0"))
        .withColumn(y, F.greatest(F.col(y) - F.col("_y0"), F.lit(0.0)))
        .drop("_t0", "_y0")
    )


def whole_trace(df: DataFrame, keys: Sequence[str], t: str, y: str, *, min_rows: int = 15, frame: str = "frame") -> DataFrame:
    """Present rows re-zeroed in time, for traces with at least ``min_rows`` of them."""
    present = df.filter(F.col(t).isNotNull() & F.col(y).isNotNull())
    counted = with_summary(present, keys, F.count(F.lit(1)).alias("_n"), F.min_by(t, frame).alias("_t0"), frame=frame)
    return counted.filter(F.col("_n") >= min_rows).withColumn(t, F.col(t) - F.col("_t0")).drop("_n", "_t0")


def before_marker(
    df: DataFrame, keys: Sequence[str], t: str, y: str, condition: str, marker_t: str, *, min_rows: int = 15, frame: str = "frame",
) -> DataFrame:
    """Controls whole; pulsed traces only where positive and before the marker; short ones dropped."""
    control = F.col(condition) == "ASP"
    kept = df.filter(
        F.col(y).isNotNull() & (control | ((F.col(y) > 0) & (F.col(t) < F.col(marker_t))))
    )
    return whole_trace(kept, keys, t, y, min_rows=min_rows, frame=frame)


def densify(df: DataFrame, keys: Sequence[str], *, fill: float | None = None, frame: str = "frame") -> DataFrame:
    """Every frame from 0 to the last one; absent frames hold ``fill`` (NULL by default).

    The spine is cut per present row up to the next one, so no task lists a whole trace.
    """
    df = without_chunks(df)
    values = [c for c in df.columns if c not in keys and c != frame]
    positions = df.select(*keys, frame).distinct()
    first = positions.groupBy(*keys).agg(F.min(frame).alias(frame))
    gap = _next_frame(positions, keys, frame)
    spans = gap.select(*keys, F.explode(F.sequence(F.col(frame), F.col("_next") - 1)).alias(frame))
    lead_in = first.filter(F.col(frame) > 0).select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(frame) - 1)).alias(frame)
    )
    out = spans.unionByName(lead_in).join(df, [*keys, frame], "left")
    return out if fill is None else out.na.fill(fill, values)


def _next_frame(positions: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """Each present frame with the following present frame (itself + 1 at the end)."""
    dense = renumber(positions, keys, frame=frame, out="_pos")
    ahead = rolling(dense, keys, {"_n": lambda w: F.lead(frame).over(w)}, after=1, frame="_pos")
    return ahead.select(*keys, frame, F.coalesce("_n", F.col(frame) + 1).alias("_next"))
