"""Counts, per-trace summaries and two-level aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraces.functions.labels import BUCKETS
from sparktraces.functions.physics import sphere_volume
from sparktraces.operators.cohorts import full_counts
from sparktraces.operators.quantiles import quantiles
from sparktraces.operators.sequence import attach, summarise

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def counts_wide(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], *, total: str | None = None) -> DataFrame:
    """One count column per listed value, zero where absent, with an optional total of all rows."""
    aggs = [F.count_if(F.col(column) == v).alias(str(v)) for v in values]
    if total:
        aggs.append(F.count(F.lit(1)).alias(total))
    return df.groupBy(*rows).agg(*aggs)


def attrition(df: DataFrame, experiment: Sequence[str], bucket: str) -> DataFrame:
    """Candidates per experiment in each outcome bucket, with their total."""
    return counts_wide(df, experiment, bucket, BUCKETS, total="total_candidates")


def shares(counts: DataFrame, columns: Sequence[str], *, suffix: str = "_share") -> DataFrame:
    """Row total and each column's share of it, 0 for an empty row."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    out = counts.withColumn("row_total", total)
    return out.select(
        *counts.columns,
        "row_total",
        *[F.coalesce(F.try_divide(F.col(c), F.col("row_total")), F.lit(0.0)).alias(f"{c}{suffix}") for c in columns],
    )


def fate_fractions(outcomes: DataFrame, excluded: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Outcome counts joined with excluded counts; fractions are missing when their base is zero."""
    both = full_counts(outcomes, excluded, groups)
    analysed = F.col("intact") + F.col("ruptured_post")
    candidates = analysed + F.col("excluded")
    return (
        both.withColumn("analysis_total", analysed)
        .withColumn("candidate_total", candidates)
        .withColumn("fraction_ruptured", F.try_divide(F.col("ruptured_post"), F.col("analysis_total")))
        .withColumn("fraction_excluded", F.try_divide(F.col("excluded"), F.col("candidate_total")))
    )


def column_maxima(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Largest present value of each column per trace."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(f"max_{c}") for c in columns])


def group_sizes(df: DataFrame, groups: Sequence[str], label: Column) -> DataFrame:
    return df.groupBy(*groups).agg(F.min(label).alias("label"), F.count(F.lit(1)).alias("n"))


def box(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Quartiles and count of the present values."""
    return quantiles(df, groups, value, QUARTILES, count="n")


def replicate_mean(df: DataFrame, category: Sequence[str], replicate: Sequence[str], value: str) -> DataFrame:
    """Mean of replicate means with its sample SEM (0 for a single replicate)."""
    means = replicate_means(df, category, replicate, value)
    n = F.count("replicate_mean")
    return means.groupBy(*category).agg(
        F.avg("replicate_mean").alias("mean"),
        F.coalesce(F.stddev_samp("replicate_mean") / F.sqrt(n), F.lit(0.0)).alias("sem"),
        n.alias("replicates"),
    )


def replicate_means(df: DataFrame, category: Sequence[str], replicate: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*category, *replicate).agg(F.avg(value).alias("replicate_mean"))


def trace_spans(df: DataFrame, keys: Sequence[str], carry: Sequence[str], t: str, marker: str, *, frame: str = "frame") -> DataFrame:
    """Per trace: rows, duration, marker frame, and time before and after the marker."""
    start, end = F.min_by(t, frame), F.max_by(t, frame)
    at = F.max(F.when(F.col(frame) == F.col(marker), F.col(t)))
    return df.groupBy(*keys, *carry).agg(
        F.count(F.lit(1)).alias("rows"),
        (end - start).alias("duration"),
        F.max(marker).alias("marker"),
        (at - start).alias("pre_duration"),
        (end - at).alias("post_duration"),
    )


def window_constants(spans: DataFrame, groups: Sequence[str], condition: str, *, min_rows: int = 15) -> DataFrame:
    """One row: least of the group medians of the whole, control and pre-marker durations.

    Traces under ``min_rows`` rows do not count, nor do markers before row ``min_rows``.
    """
    long = spans.filter(F.col("rows") >= min_rows)
    by = list(dict.fromkeys([*groups, condition]))
    whole = quantiles(long, by, "duration", {"m": 0.5})
    pre = quantiles(
        long.filter((F.col(condition) == "EP") & (F.col("marker") >= min_rows)), by, "pre_duration", {"p": 0.5}
    )
    return whole.join(pre, by, "left").agg(
        F.min("m").alias("whole_window"),
        F.min(F.when(F.col(condition) == "ASP", F.col("m"))).alias("control_window"),
        F.min("p").alias("pre_window"),
    )


def common_duration(spans: DataFrame, groups: Sequence[str], duration: str, *, fraction: float = 0.5) -> DataFrame:
    """Shortest duration that is at least ``fraction`` of the group mean; needs two traces before and after the cut."""
    rows = spans.filter(F.col(duration) > 0)
    means = rows.groupBy(*groups).agg(F.avg(duration).alias("_m"), F.count(F.lit(1)).alias("_n"))
    kept = rows.join(means, list(groups)).filter((F.col("_n") >= 2) & (F.col(duration) >= fraction * F.col("_m")))
    return (
        kept.groupBy(*groups)
        .agg(F.min(duration).alias("common"), F.count(F.lit(1)).alias("kept"))
        .filter(F.col("kept") >= 2)
    )


def common_post_duration(spans: DataFrame, groups: Sequence[str], duration: str, *, cap: float = 5.0) -> DataFrame:
    rows = spans.filter(F.col(duration) > 0)
    return (
        rows.groupBy(*groups)
        .agg(F.least(F.min(duration), F.lit(cap)).alias("common_post"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= 2)
        .drop("_n")
    )


def axis_limits(extents: DataFrame, groups: Sequence[str], *, fraction: float = 0.2, max_pre: float = 30.0) -> DataFrame:
    """Shared axis from per-trace ``t_min`` / ``t_max``: the shortest normal end, and the median start but not before -max_pre."""
    ends = extents.filter(F.col("t_max") > 0)
    mid = quantiles(ends, groups, "t_max", {"_mid": 0.5})
    normal = ends.join(mid, list(groups)).groupBy(*groups).agg(
        F.coalesce(F.min(F.when(F.col("t_max") >= fraction * F.col("_mid"), F.col("t_max"))), F.min("t_max")).alias("x_max")
    )
    starts = quantiles(extents, groups, "t_min", {"_start": 0.5})
    return normal.join(starts, list(groups)).select(
        *groups, F.greatest(F.col("_start"), F.lit(-max_pre)).alias("x_min"), "x_max"
    )


def matrix(df: DataFrame, row: str, column: str, values: Sequence[int], value: str, *, prefix: str = "c") -> DataFrame:
    """Mean per (row, column value) laid out wide, one column per listed value, and ``outside``: rows under other values."""
    listed = F.coalesce(F.col(column).isin(*values), F.lit(False))
    cells = [F.avg(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(row).agg(*cells, F.count_if(~listed).alias("outside"))


def last_before_marker(df: DataFrame, keys: Sequence[str], marker: str, columns: Sequence[str], *, rows: int = 10, n_rows: str, frame: str = "frame") -> DataFrame:
    """Median of each column over the last rows before the marker, or of the trace end without one."""
    valid = (F.col(marker) > 0) & (F.col(marker) < F.col(n_rows))
    end = F.when(valid, F.col(marker)).otherwise(F.col(n_rows))
    inside = (F.col(frame) < end) & (F.col(frame) >= end - rows)
    return df.groupBy(*keys).agg(
        *[F.percentile(F.when(inside, F.col(c)), F.lit(0.5)).alias(f"{c}_before") for c in columns]
    )


def with_sphere_volume(df: DataFrame, area: str, *, out: str = "volume_before") -> DataFrame:
    return df.withColumn(out, F.when(F.col(area) > 0, sphere_volume(F.col(area))))


def pre_post_over_baseline(df: DataFrame, keys: Sequence[str], y: str, f0: str, marker: str, condition: str, *, n_rows: str, frame: str = "frame") -> DataFrame:
    """Mean positive value before and from the marker on, over the first positive F0 of the trace.

    Controls and markers outside the trace use the whole trace as "before".
    """
    pulsed = F.coalesce((F.col(condition) == "EP") & (F.col(marker) > 0) & (F.col(marker) < F.col(n_rows)), F.lit(False))
    value = F.when(F.col(y) > 0, F.col(y))
    base = F.min_by(f0, F.when(F.col(f0) > 0, F.col(frame)))
    return df.groupBy(*keys).agg(
        base.alias("f0"),
        (F.avg(F.when(~pulsed | (F.col(frame) < F.col(marker)), value)) / base).alias("pre_norm"),
        (F.avg(F.when(pulsed & (F.col(frame) >= F.col(marker)), value)) / base).alias("post_norm"),
    )


def first_present(value: Column, frame: str, *, positive: bool = False) -> Column:
    """Earliest present (or positive) value of a trace, as an aggregate."""
    ok = value > 0 if positive else value.isNotNull()
    return F.min_by(value, F.when(ok, F.col(frame)))


def baselines(df: DataFrame, keys: Sequence[str], regions: Mapping[str, str], marker: str, *, rows: int, fallback: str, frame: str = "frame") -> DataFrame:
    """Mean of each region over the rows before the marker (the first rows without one).

    A region with no value takes the ``total`` baseline, ``tip`` takes ``prot`` first,
    and a missing or zero total takes the fallback column's mean.
    """
    start = F.when(F.col(marker).isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col(marker) - rows))
    stop = F.when(F.col(marker).isNull(), F.lit(rows)).otherwise(F.col(marker))
    inside = (F.col(frame) >= start) & (F.col(frame) < stop)
    raw = df.groupBy(*keys).agg(
        *[F.avg(F.when(inside, F.col(c))).alias(f"_{r}") for r, c in regions.items()],
        F.avg(F.when(inside, F.col(fallback))).alias("_fallback"),
    )
    total = F.nullif(F.col("_total"), F.lit(0.0))
    chain = {r: F.coalesce(F.when(total.isNotNull(), F.col(f"_{r}")), total, F.col("_fallback"), F.lit(0.0)) for r in regions}
    if "tip" in regions:
        chain["tip"] = F.coalesce(F.when(total.isNotNull(), F.coalesce("_tip", "_prot")), total, F.col("_fallback"), F.lit(0.0))
    return raw.select(*keys, *[c.alias(f"f0_{r}") for r, c in chain.items()])


def remodelling(df: DataFrame, keys: Sequence[str], y: str, marker: str, *, before: int = 5, after: int = 10, n_rows: str, frame: str = "frame") -> DataFrame:
    """Mean before and after the marker (excluded), their ratio and difference.

    Without a marker the first ``before`` rows are compared with the last ``after``.
    """
    at, f, none = F.col(marker), F.col(frame), F.col(marker).isNull()
    pre = F.when(none, f < before).otherwise((f >= at - before) & (f < at))
    post = F.when(none, f >= F.col(n_rows) - after).otherwise((f > at) & (f <= at + after))
    out = df.groupBy(*keys).agg(
        F.avg(F.when(pre, F.col(y))).alias("pre_mean"), F.avg(F.when(post, F.col(y))).alias("post_mean")
    )
    return out.withColumn("ratio", F.col("post_mean") / F.greatest(F.col("pre_mean"), F.lit(1e-6))).withColumn(
        "difference", F.col("post_mean") - F.col("pre_mean")
    )


def change_percent(df: DataFrame, keys: Sequence[str], y: str, start: str, stop: str, *, rows: int = 3, frame: str = "frame") -> Column:
    """Aggregate: change in percent from the first to the last rows of [start, stop), 0 without a positive base."""
    f = F.col(frame)
    base = F.avg(F.when((f >= F.col(start)) & (f < F.col(start) + rows), F.col(y)))
    last = F.avg(F.when((f >= F.greatest(F.col(start), F.col(stop) - rows)) & (f < F.col(stop)), F.col(y)))
    return F.when((F.max(F.col(stop) - F.col(start)) > 0) & (base > 0), (last - base) / F.nullif(base, F.lit(0.0)) * 100).otherwise(0.0)


def phase_changes(df: DataFrame, keys: Sequence[str], y: str, shape: str, marker: str, event: str, *, frame: str = "frame") -> DataFrame:
    """Per trace: change before and after the marker, and mean and population SD of ``shape`` in each phase.

    The window opens at the first row with a shape and closes at the event, or past the last such row.
    """
    has_shape = F.col(shape).isNotNull()
    bounds = summarise(
        df,
        keys,
        F.min(F.when(has_shape, F.col(frame))).alias("_start"),
        F.coalesce(F.max(F.when(F.col(event) > 0, F.col(event))), F.max(F.when(has_shape, F.col(frame))) + 1).alias("_stop"),
        F.count(shape).alias("_n"),
        frame=frame,
    ).filter(F.col("_n") >= 3)
    rows = attach(df, bounds, keys, frame=frame, how="inner")
    split = F.coalesce((F.col(marker) > F.col("_start")) & (F.col(marker) < F.col("_stop")), F.lit(False))
    rows = rows.withColumn("_mid", F.when(split, F.col(marker)).otherwise(F.col("_stop"))).withColumn("_split", split)
    f = F.col(frame)
    pre = F.when((f >= F.col("_start")) & (f < F.col("_mid")), F.col(shape))
    post = F.when(F.col("_split") & (f >= F.col("_mid")) & (f < F.col("_stop")), F.col(shape))
    return rows.groupBy(*keys).agg(
        change_percent(rows, keys, y, "_start", "_mid", frame=frame).alias("pre_change"),
        F.when(F.bool_or("_split"), change_percent(rows, keys, y, "_mid", "_stop", frame=frame)).alias("post_change"),
        F.avg(pre).alias("pre_shape_mean"),
        F.stddev_pop(pre).alias("pre_shape_sd"),
        F.avg(post).alias("post_shape_mean"),
        F.stddev_pop(post).alias("post_shape_sd"),
    )


def dose_table(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """N, mean, sample SD, SEM, median, min and max per dose."""
    stats = df.groupBy(*groups).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    return stats.join(quantiles(df, groups, value, {"median": 0.5}), list(groups))


def histogram_bin(value: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based bin of a value inside [lo, hi]: the last edge lo + k * width at or below it; the last bin is closed."""
    width = (hi - lo) / bins
    near = F.floor((value - lo) / width)
    down = (value < lo + near * width).cast("int")
    up = (value >= lo + (near + 1) * width).cast("int")
    return F.when(value.between(lo, hi), F.least(near - down + up + 1, F.lit(bins))).cast("long")


def histogram_mean(df: DataFrame, group: str, unit: str, value: str, *, lo: float = 0.0, hi: float = 1.0, bins: int = 20) -> DataFrame:
    """Mean and sample SEM over units of the count in each bin; units without a value in a bin count as 0."""
    units = df.groupBy(group).agg(F.count_distinct(unit).alias("_units"))
    counts = (
        df.withColumn("bin", histogram_bin(F.col(value), lo, hi, bins))
        .filter(F.col("bin").isNotNull())
        .groupBy(group, unit, "bin")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    sums = counts.groupBy(group, "bin").agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_ss"))
    every = units.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))))
    n, s, ss = F.col("_units"), F.coalesce("_s", F.lit(0)), F.coalesce("_ss", F.lit(0))
    var = F.try_divide(ss - s * s / n, n - 1)
    return every.join(sums, [group, "bin"], "left").select(
        group, "bin", (s / n).alias("mean"), (F.sqrt(F.greatest(var, F.lit(0.0))) / F.sqrt(n)).alias("sem")
    )


def density(df: DataFrame, group: str, value: str, *, lo: float, hi: float, bins: int) -> DataFrame:
    """Histogram density per group: count / (n * bin width)."""
    placed = df.withColumn("bin", histogram_bin(F.col(value), lo, hi, bins)).filter(F.col("bin").isNotNull())
    totals = placed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return (
        placed.groupBy(group, "bin")
        .agg(F.count(F.lit(1)).alias("count"))
        .join(totals, group)
        .select(group, "bin", "count", (F.col("count") / (F.col("_n") * ((hi - lo) / bins))).alias("density"))
    )


def upper_cap(df: DataFrame, groups: Sequence[str], value: str, *, share: float = 0.99, margin: float = 1.1) -> DataFrame:
    """One row: margin times the largest group percentile."""
    return quantiles(df, groups, value, {"_p": share}).agg((F.max("_p") * margin).alias("cap"))


def safe_max(value: Column, default: float) -> Column:
    """Aggregate: the maximum, or a default when nothing is present or finite."""
    top = F.max(F.when(~F.isnan(value), value))
    return F.coalesce(F.when(top < float("inf"), top), F.lit(default))
