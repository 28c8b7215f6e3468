"""Event detection in traces: entry, exit, alarms, veto and arbitration.

Run rules ("n rows in a row") look a fixed number of rows ahead, so they need no
state; the drift sum is the only one that crosses chunks (`running_sum`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from sparktraces.operators.quantiles import quantiles
from sparktraces.operators.sequence import attach, rolling, running_sum, summarise

IQR_TO_SIGMA = 0.7413


# Detector defaults, in the units of the signal and in rows.
@dataclass(frozen=True)
class Settings:
    settling: int = 3
    baseline: int = 5
    lag: int = 0
    noise_floor: float = 1.0
    max_sigma: float = 1.0
    spike_sigma: float = 6.0
    step_sigma: float = 6.0
    min_drift: float = 0.2
    drift_factor: float = 0.5
    min_sum: float = 2.0
    sum_factor: float = 8.0
    jump: float = 1.0
    anchor_rows: int = 5
    anchor_scan: int = 5
    anchor_fold: float = 1.5
    anchor_rise: float = 1.0
    marker_rows: int = 5
    marker_peak: int = 2
    marker_fold: float = 1.3
    marker_rise: float = 0.5
    retention: float = 0.80
    solidity: float = 0.85
    veto_rows: int = 10
    veto_ratio: float = 0.90
    local_fold: float = 2.0
    local_rise: float = 5.0
    total_fold: float = 1.7
    total_rise: float = 3.0

    @property
    def warm_up(self) -> int:
        return self.settling + self.baseline + self.lag


# Candidate kinds in the order that breaks ties.
KINDS = ["not_displaced", "spike", "step", "jump", "drift", "anchored_rise", "marker"]


def run_starts(flag: Column, rows: int, w: WindowSpec) -> Column:
    """True where this row and the next ``rows - 1`` all hold."""
    ahead = [flag] + [F.coalesce(F.lead(flag, i).over(w), F.lit(False)) for i in range(1, rows)]
    return reduce(lambda a, b: a & b, ahead)


def sustained_entry(
    df: DataFrame, keys: Sequence[str], length: str, area: str, *, threshold: float = 0.5,
    channel_length: float = 40.0, max_fraction: float = 0.9, min_area: float = 10.0, rows: int = 3,
    frame: str = "frame",
) -> DataFrame:
    """(trace, entry_frame, entry_confirmed): one row before the first run of valid rows, else 0."""
    y = F.col(length)
    valid = F.coalesce(
        (y > threshold) & (y < channel_length * max_fraction) & (F.coalesce(F.col(area), F.lit(0.0)) >= min_area),
        F.lit(False),
    )
    marked = rolling(
        df.withColumn("_ok", valid), keys, {"_run": lambda w: run_starts(F.col("_ok"), rows, w)}, after=rows - 1, frame=frame
    )
    first = F.min(F.when(F.col("_run"), F.col(frame)))
    return summarise(
        marked,
        keys,
        F.coalesce(F.greatest(F.lit(0), first - 1), F.lit(0)).cast("long").alias("entry_frame"),
        first.isNotNull().alias("entry_confirmed"),
        (F.max(frame) + 1).alias("trace_rows"),
        frame=frame,
    )


def sustained_exit(
    df: DataFrame, keys: Sequence[str], length: str, entry: DataFrame, *, marker: str | None = None,
    threshold: float = 0.5, drop_ratio: float = 0.2, drop_from: float = 3.0, rows: int = 3, blank: int = 5,
    frame: str = "frame",
) -> DataFrame:
    """Adds exit_frame to ``entry``: start of the first run of lost rows from entry + 5, else the row count.

    Rows from one before the marker to ``blank`` after it break a run.
    """
    y = F.col(length)

    def lost(w: WindowSpec) -> Column:
        before = F.lag(length).over(w)
        gone = F.coalesce((y < threshold) | ((before > drop_from) & (y < drop_ratio * before)), F.lit(False))
        if marker:
            gone = gone & ~F.coalesce(F.col(frame).between(F.col(marker) - 1, F.col(marker) + blank), F.lit(False))
        return gone

    marked = rolling(
        df,
        keys,
        {"_lost": lost, "_run": lambda w: run_starts(F.col("_lost"), rows, w)},
        before=1,
        after=rows,
        frame=frame,
    )
    found = attach(marked, entry, keys, frame=frame).filter(
        F.col("_run") & (F.col(frame) >= F.col("entry_frame") + 5)
    )
    exits = found.groupBy(*keys).agg(F.min(frame).alias("_exit"))
    return entry.join(exits, list(keys), "left").withColumn(
        "exit_frame", F.coalesce("_exit", "trace_rows").cast("long")
    ).drop("_exit")


def baseline(y: str, s: Settings, w: WindowSpec) -> Column:
    """Struct (mu, sigma) of the rows just before: median and capped, floored scaled IQR."""
    frame = w.rowsBetween(-(s.lag + s.baseline), -(s.lag + 1))
    q = F.expr(f"percentile(`{y}`, array(0.25, 0.5, 0.75))").over(frame)
    return F.struct(q[1].alias("mu"), capped_sigma(q[2] - q[0], s).alias("sigma"))


def capped_sigma(iqr: Column, s: Settings) -> Column:
    return F.greatest(F.least(iqr * IQR_TO_SIGMA, F.lit(s.max_sigma)), F.lit(s.noise_floor))


def active_rows(df: DataFrame, keys: Sequence[str], bounds: DataFrame, y: str, s: Settings, *, frame: str = "frame") -> DataFrame:
    """Rows of confirmed traces between entry and a little past exit, with what the alarms look at.

    ``rel`` counts from the entry row and ``active`` is the number of rows in the
    slice; ``_base`` is the rolling baseline, ``_step`` the last one-row change and
    ``_scan`` the median of the rows ahead.
    """
    reach = s.anchor_scan - 1
    seen = rolling(
        df,
        keys,
        {
            "_base": lambda w: baseline(y, s, w),
            "_step": lambda w: F.col(y) - F.lag(y).over(w),
            "_scan": lambda w: F.expr(f"percentile(`{y}`, 0.5)").over(w.rowsBetween(0, reach)),
        },
        before=max(1, s.lag + s.baseline),
        after=reach,
        frame=frame,
    )
    joined = attach(seen, bounds, keys, frame=frame, how="inner")
    return (
        joined.withColumn("_end", F.least("trace_rows", F.col("exit_frame") + 3))
        .filter(F.col("entry_confirmed") & (F.col(frame) >= F.col("entry_frame")) & (F.col(frame) < F.col("_end")))
        .withColumn("rel", F.col(frame) - F.col("entry_frame"))
        .withColumn("active", F.col("_end") - F.col("entry_frame"))
        .drop("_end")
    )


def alarms(rows: DataFrame, keys: Sequence[str], y: str, s: Settings, *, frame: str = "frame") -> DataFrame:
    """One row per trace with the first frame of each alarm, NULL where it stays silent.

    ``rows`` come from `active_rows`.  spike and step: above the baseline by so many
    deviations.  drift: the sum of positive deviations, zeroed by any other row,
    passes its limit; slices shorter than the warm-up use their first three rows as
    a fixed baseline.  jump: the largest one-row rise after settling, when large
    enough.  anchored_rise: a median well above that of the first rows.
    """
    value, rel, active, at = F.col(y), F.col("rel"), F.col("active"), F.col(frame)
    short = active < s.warm_up + 1
    head = F.when(short & (rel < 3), value)
    heads = summarise(
        rows,
        keys,
        F.percentile(head, F.lit(0.5)).alias("_m"),
        (F.percentile(head, F.lit(0.75)) - F.percentile(head, F.lit(0.25))).alias("_iqr"),
        F.percentile(F.when(rel < s.anchor_rows, value), F.lit(0.5)).alias("_anchor"),
        frame=frame,
    )
    mu = F.when(short, F.col("_m")).otherwise(F.col("_base.mu"))
    sigma = F.when(short, capped_sigma(F.col("_iqr"), s)).otherwise(F.col("_base.sigma"))
    started = rel >= F.when(short, 3).otherwise(s.warm_up)
    scored = (
        attach(rows, heads, keys, frame=frame)
        .withColumn("_dev", F.when(started, value - mu - F.greatest(F.lit(s.min_drift), s.drift_factor * sigma)))
        .withColumn("_limit", F.greatest(F.lit(s.min_sum), s.sum_factor * sigma))
        .withColumn("_cut", F.coalesce(F.col("_dev") <= 0, F.lit(True)))
    )
    summed = running_sum(scored, keys, F.col("_dev"), reset=F.col("_cut"), out="_sum", frame=frame)

    over = value - F.col("_base.mu")
    ready = rel >= s.warm_up
    risen = (
        (active > s.anchor_rows + s.anchor_scan)
        & (F.col("_anchor") >= s.noise_floor)
        & rel.between(s.anchor_rows, active - s.anchor_scan)
        & (F.col("_scan") >= s.anchor_fold * F.col("_anchor"))
        & (F.col("_scan") - F.col("_anchor") >= s.anchor_rise)
    )
    step = F.when(rel > s.settling, F.struct(F.col("_step").alias("step"), (-at).alias("back")))

    def first(hit: Column) -> Column:
        return F.min(F.when(hit, at)).cast("long")

    return (
        summed.groupBy(*keys)
        .agg(
            first(ready & (over > s.spike_sigma * F.col("_base.sigma"))).alias("spike"),
            first(ready & (over > s.step_sigma * F.col("_base.sigma"))).alias("step"),
            F.max(step).alias("_rise"),
            first(F.col("_sum") > F.col("_limit")).alias("drift"),
            first(risen).alias("anchored_rise"),
        )
        .withColumn("jump", F.when(F.col("_rise.step") > max(s.jump, s.min_drift), -F.col("_rise.back")).cast("long"))
        .drop("_rise")
    )


def marker_alarm(
    df: DataFrame, keys: Sequence[str], y: str, bounds: DataFrame, marker: str, s: Settings, *, frame: str = "frame"
) -> DataFrame:
    """The marker row, when the signal after it stays or peaks above the signal before it."""
    near = attach(df, bounds, keys, frame=frame, how="inner").filter(
        F.col("entry_confirmed")
        & (F.col(marker) - s.marker_rows >= F.col("entry_frame"))
        & (F.col(marker) > F.col("entry_frame"))
        & (F.col(marker) + s.marker_rows < F.col("trace_rows"))
        & F.col(frame).between(F.col(marker) - s.marker_rows, F.col(marker) + s.marker_rows)
    )
    offset = F.col(frame) - F.col(marker)
    stats = near.groupBy(*keys).agg(
        F.max(marker).cast("long").alias("at_frame"),
        F.percentile(F.when(offset < 0, F.col(y)), F.lit(0.5)).alias("_pre"),
        F.percentile(F.when(offset > 0, F.col(y)), F.lit(0.5)).alias("_post"),
        F.max(F.when((offset > 0) & (offset <= s.marker_peak), F.col(y))).alias("_peak"),
    )

    def above(v: str) -> Column:
        return (F.col(v) >= s.marker_fold * F.col("_pre")) & (F.col(v) - F.col("_pre") >= s.marker_rise)

    return stats.filter((F.col("_pre") >= 0.1) & (above("_post") | above("_peak"))).select(
        *keys, "at_frame", F.lit("marker").alias("kind")
    )


def displacement_check(
    df: DataFrame, keys: Sequence[str], y: str, solidity: str, bounds: DataFrame, s: Settings, *, frame: str = "frame"
) -> DataFrame:
    """The entry row, when the signal did not fall on entry and the outline is fragmented."""
    rows = attach(df, bounds, keys, frame=frame, how="inner").filter(
        F.col("entry_confirmed") & (F.col("entry_frame") > 0)
    )
    empty = quantiles(rows.filter(F.col(frame) < F.col("entry_frame")), keys, y, {"_empty": 0.5})
    at = F.col(frame) - F.col("entry_frame")
    entered = rows.groupBy(*keys).agg(
        F.max("entry_frame").cast("long").alias("at_frame"),
        F.percentile(F.when(at.between(0, 2), F.col(y)), F.lit(0.5)).alias("_signal"),
        F.max(F.when(at == 0, F.col(solidity))).alias("_solid"),
    )
    kept = F.col("_signal") >= F.greatest(F.col("_empty"), F.lit(s.noise_floor)) * s.retention
    return (
        entered.join(empty, list(keys))
        .filter(kept & (F.col("_solid") < s.solidity))
        .select(*keys, "at_frame", F.lit("not_displaced").alias("kind"))
    )


def candidates(
    df: DataFrame, keys: Sequence[str], y: str, bounds: DataFrame, *, marker: str | None = None,
    solidity: str | None = None, settings: Settings = Settings(), frame: str = "frame",
) -> DataFrame:
    """All detectors over one signal: (trace, at_frame, kind)."""
    s = settings
    wide = alarms(active_rows(df, keys, bounds, y, s, frame=frame), keys, y, s, frame=frame)
    found = [
        wide.unpivot(list(keys), ["spike", "step", "jump", "drift", "anchored_rise"], "kind", "at_frame")
        .filter(F.col("at_frame").isNotNull())
    ]
    if solidity:
        found.append(displacement_check(df, keys, y, solidity, bounds, s, frame=frame))
    if marker:
        found.append(marker_alarm(df, keys, y, bounds, marker, s, frame=frame))
    return reduce(lambda a, b: a.unionByName(b), found)


def veto(
    df: DataFrame, keys: Sequence[str], y: str, length: str, found: DataFrame, bounds: DataFrame, *,
    settings: Settings = Settings(), frame: str = "frame",
) -> DataFrame:
    """Candidates that survive the length check.

    A candidate stays when the length falls after it, when its kind is exempt,
    when the signal rise is large on its own, or when too few rows can judge.
    Each candidate asks for the rows around it by frame, an equality join.
    """
    s = settings
    spread = found.join(bounds.select(*keys, "entry_frame", "exit_frame"), list(keys)).withColumn(
        frame, F.explode(F.sequence(F.col("at_frame") - s.veto_rows, F.col("at_frame") + s.veto_rows - 1))
    )
    near = spread.join(df.select(*keys, frame, y, length), [*keys, frame], "left")
    at = F.col(frame) - F.col("at_frame")
    before, after = F.when(at.between(-5, -1), F.col(y)), F.when(at.between(0, 4), F.col(y))
    inside = F.col(frame).between(F.col("entry_frame"), F.col("exit_frame"))
    shape = F.when(inside, F.col(length))
    start = summarise_start(df, keys, y, bounds, frame=frame)
    scored = (
        near.groupBy(*keys, "kind", "at_frame")
        .agg(
            F.percentile(before, F.lit(0.5)).alias("_pre"),
            F.percentile(after, F.lit(0.5)).alias("_post"),
            F.least(F.count(before), F.count(after)).alias("_n_signal"),
            F.avg(F.when(at < 0, shape)).alias("_len_pre"),
            F.avg(F.when(at >= 0, shape)).alias("_len_post"),
            F.least(F.count(F.when(at < 0, shape)), F.count(F.when(at >= 0, shape))).alias("_n_len"),
        )
        .join(start, list(keys), "left")
    )

    def risen(reference: str, fold: float, rise: float) -> Column:
        r = F.col(reference)
        return F.coalesce((r > 0) & (F.col("_post") / F.nullif(r, F.lit(0.0)) >= fold) & (F.col("_post") - r >= rise), F.lit(False))

    bypass = (F.col("_n_signal") >= 2) & (
        risen("_pre", s.local_fold, s.local_rise) | risen("_start", s.total_fold, s.total_rise)
    )
    falling = (F.col("_len_pre") > 0) & (F.col("_len_post") / F.nullif(F.col("_len_pre"), F.lit(0.0)) < s.veto_ratio)
    keep = F.col("kind").isin("not_displaced", "marker") | bypass | (F.col("_n_len") < 3) | F.coalesce(falling, F.lit(False))
    return scored.filter(keep).select(*keys, "at_frame", "kind")


def summarise_start(df: DataFrame, keys: Sequence[str], y: str, bounds: DataFrame, *, frame: str = "frame") -> DataFrame:
    """Median signal of the first five rows after entry, inside the active slice."""
    rel = F.col(frame) - F.col("entry_frame")
    return (
        attach(df, bounds, keys, frame=frame, how="inner")
        .filter(rel.between(0, 4) & (F.col(frame) < F.col("exit_frame") + 3))
        .groupBy(*keys)
        .agg(F.percentile(y, F.lit(0.5)).alias("_start"))
    )


def arbitrate(found: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The earliest candidate per trace, ties by kind order, moved to at most one row before exit."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    first = found.groupBy(*keys).agg(
        F.min(F.struct("at_frame", order.alias("o"), "kind")).alias("_first")
    )
    return bounds.join(first, list(keys), "left").select(
        *keys,
        "entry_frame",
        "exit_frame",
        "entry_confirmed",
        F.col("_first").isNotNull().alias("event_found"),
        F.when(
            F.col("_first").isNotNull(),
            F.least(F.col("_first.at_frame"), F.greatest(F.lit(0), F.col("exit_frame") - 1)),
        ).alias("event_frame"),
        F.col("_first.kind").alias("event_kind"),
    )
