"""Ordered work inside a trace without putting a whole trace in one task.

A trace may hold a large share of all rows, so nothing here opens a window over
a full trace.  Rows are cut into chunks of consecutive frames; a window runs per
(trace, chunk), neighbouring chunks share a few halo rows, and anything that
must cross chunks travels as one summary row per chunk.

Operators leave the chunk number on their rows in a column named by
`chunk_column`.  Rows that already carry it are laid out by (trace, chunk), and
later operators on the same frame column reuse that layout without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sparktraces.operators.stage import lookup_side

CHUNK_ROWS = 65_536


def floor_div(value: Column, size: int) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def chunk_column(frame: str = "frame", chunk_rows: int = CHUNK_ROWS) -> str:
    return f"_{frame}_by_{chunk_rows}"


def chunked(df: DataFrame, frame: str = "frame", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with their chunk number."""
    name = chunk_column(frame, chunk_rows)
    return df if name in df.columns else df.withColumn(name, floor_div(F.col(frame), chunk_rows))


def spread(df: DataFrame, keys: Sequence[str], frame: str = "frame", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows laid out by (trace, chunk) over all shuffle partitions, for steps that multiply rows.

    A plain shuffle may be merged into few tasks because its input is small; an
    explicit partition count is kept.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunked(df, frame, chunk_rows).repartition(n, *keys, chunk_column(frame, chunk_rows))


def without_chunks(df: DataFrame) -> DataFrame:
    """Rows without any layout column, for output."""
    return df.drop(*[c for c in df.columns if c.startswith("_") and "_by_" in c])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    clock: str,
    *,
    frame: str = "frame",
    n_rows: str | None = None,
    start: str | None = None,
    bucket: Column | None = None,
    bucket_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """0-based position of each row in its trace, ordered by ``order``.

    ``clock`` is a non-null number that never decreases along ``order``.  Traces of
    up to ``bucket_rows`` rows are numbered by one window.  The clock range of a
    longer one is cut into about ``rows / bucket_rows`` buckets: its rows are
    numbered inside (trace, bucket) and shifted by the rows of earlier buckets.
    Which traces are long is counted first, in a pass of its own; a ``bucket`` that
    never decreases along ``order`` may be given instead.
    ``n_rows`` and ``start`` name optional outputs: rows in the trace and its first
    clock value.
    """
    keys = list(keys)
    if bucket is not None:
        placed = df.withColumn("_bucket", bucket)
    else:
        placed = _clock_buckets(df, keys, clock, bucket_rows)
    if placed is None:
        whole = Window.partitionBy(*keys)
        out = df.withColumn(frame, F.row_number().over(whole.orderBy(*order)).cast("long") - 1)
        if n_rows:
            out = out.withColumn(n_rows, F.count(F.lit(1)).over(whole))
        if start:
            out = out.withColumn(start, F.min(clock).over(whole))
        return out.drop(chunk_column(frame))
    counts = placed.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.min(clock).alias("_first")
    )
    along = Window.partitionBy(*keys).orderBy("_bucket")
    whole = Window.partitionBy(*keys)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        *([F.sum("_n").over(whole).alias(n_rows)] if n_rows else []),
        *([F.min("_first").over(whole).alias(start)] if start else []),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        placed.withColumn("_place", local)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(frame, F.col("_offset") + F.col("_place") - 1)
        .drop("_place", "_offset", "_bucket", chunk_column(frame))
    )


def _clock_buckets(df: DataFrame, keys: Sequence[str], clock: str, bucket_rows: int) -> DataFrame | None:
    """Adds ``_bucket``, 0 for short traces; None when every trace is short.

    At most one trace in ``bucket_rows`` rows can be long, so the table of long
    traces is small; it is broadcast only when its counted size allows.
    """
    long = lookup_side(
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(clock).alias("_lo"), F.max(clock).alias("_hi"))
        .filter(F.col("_rows") > bucket_rows)
    )
    if long.isEmpty():
        return None
    width = F.col("_hi") - F.col("_lo")
    part = F.floor((F.col(clock) - F.col("_lo")) / width * F.ceil(F.col("_rows") / F.lit(bucket_rows)))
    return (
        df.join(long, list(keys), "left")
        .withColumn("_bucket", F.when(width > 0, part).otherwise(F.lit(0)).cast("long"))
        .drop("_rows", "_lo", "_hi")
    )


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    *,
    before: int = 0,
    after: int = 0,
    frame: str = "frame",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Window columns that look at most ``before`` / ``after`` frames away.

    ``frame`` must be dense (0, 1, 2, ...) in each trace.  Each callable gets the
    window of one chunk and is applied in order, so a later column may use an
    earlier one; ``before`` and ``after`` then cover the sum of their reach.
    """
    chunk = chunk_column(frame, chunk_rows)
    first = F.greatest(F.lit(0), floor_div(F.col(frame) - after, chunk_rows))
    last = floor_div(F.col(frame) + before, chunk_rows)
    out = df.withColumn(chunk, F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, chunk).orderBy(frame)
    for name, build in columns.items():
        out = out.withColumn(name, build(w))
    return out.filter(F.col(chunk) == floor_div(F.col(frame), chunk_rows))


def summarise(df: DataFrame, keys: Sequence[str], *aggs: Column, frame: str = "frame") -> DataFrame:
    """One row per trace with ``aggs`` and the last frame, ready for `attach`."""
    return df.groupBy(*keys).agg(F.max(frame).alias("_last"), *aggs)


def attach(
    df: DataFrame,
    summary: DataFrame,
    keys: Sequence[str],
    *,
    frame: str = "frame",
    how: str = "left",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Put the columns of a `summarise` result on every row of the trace.

    The summary is repeated once per chunk of its trace, so the join key is
    (trace, chunk) and a very long trace spreads over many tasks.
    """
    chunk = chunk_column(frame, chunk_rows)
    per_chunk = summary.withColumn(
        chunk, F.explode(F.sequence(F.lit(0).cast("long"), floor_div(F.col("_last"), chunk_rows)))
    ).drop("_last")
    return chunked(df, frame, chunk_rows).join(per_chunk, [*keys, chunk], how)


def with_summary(
    df: DataFrame, keys: Sequence[str], *aggs: Column, frame: str = "frame", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """`summarise` and `attach` in one step: a whole-trace aggregate on each row."""
    return attach(df, summarise(df, keys, *aggs, frame=frame), keys, frame=frame, chunk_rows=chunk_rows)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    *,
    reset: Column | None = None,
    out: str = "running",
    frame: str = "frame",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sum of ``value`` since the last row where ``reset`` holds (that row gives 0).

    Each chunk sums on its own; the open tail of a chunk is carried to the next
    ones through a table with one row per chunk.
    """
    reset = F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))
    chunk = chunk_column(frame, chunk_rows)
    w = Window.partitionBy(*keys, chunk).orderBy(frame)
    island = Window.partitionBy(*keys, chunk, "_run").orderBy(frame)
    rows = (
        chunked(df, frame, chunk_rows)
        .withColumn("_reset", reset)
        .withColumn("_add", F.when(~F.col("_reset"), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0)))
        .withColumn("_run", F.sum(F.col("_reset").cast("int")).over(w))
        .withColumn("_local", F.sum("_add").over(island))
    )
    tails = rows.groupBy(*keys, chunk).agg(
        (F.max("_run") > 0).cast("int").alias("_cut"),
        F.max_by("_local", frame).alias("_tail"),
    )
    along = Window.partitionBy(*keys).orderBy(chunk)
    carried = (
        tails.withColumn("_part", F.sum("_cut").over(along))
        .withColumn("_end", F.sum("_tail").over(Window.partitionBy(*keys, "_part").orderBy(chunk)))
        .select(*keys, chunk, F.coalesce(F.lag("_end").over(along), F.lit(0.0)).alias("_carry"))
    )
    return (
        rows.join(carried, [*keys, chunk])
        .withColumn(out, F.col("_local") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(F.lit(0.0)))
        .drop("_reset", "_add", "_run", "_local", "_carry")
    )


def renumber(
    df: DataFrame,
    keys: Sequence[str],
    *,
    frame: str = "frame",
    out: str = "frame",
    n_rows: str | None = None,
    clock: str | None = None,
    start: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Dense 0-based positions after rows were filtered away, with optional trace length and first clock value."""
    chunk = chunk_column(frame, chunk_rows)
    old = "_old_frame"
    rows = chunked(df, frame, chunk_rows).withColumn(old, F.col(frame))
    out_rows = number_rows(
        rows, keys, [old], clock or old, frame=out, n_rows=n_rows, start=start, bucket=F.col(chunk)
    )
    return out_rows.drop(old, chunk_column(out, chunk_rows))
