"""Filters, gates, key sets and joins between trace tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraces.operators.stage import lookup_side

# Cut-offs of the runaway rule and the R2 floors.
RUNAWAY_TAU_S = 20_000.0
RUNAWAY_AMPLITUDE = 100.0
R2_FLOOR = 0.85


def ordered_labels(df: DataFrame, label: str, *, first: Sequence[str] = ("ASP",), out: str = "position") -> DataFrame:
    """1-based report position of each row of a label table: named labels first, the rest by name."""
    head = F.array_position(F.array(*[F.lit(x) for x in first]), F.col(label))
    key = F.when(head > 0, head).otherwise(F.lit(len(first) + 1))
    return df.withColumn(out, F.row_number().over(Window.orderBy(key, label)).cast("long"))


def category_rank(value: Column, order: Sequence[str]) -> Column:
    """Sort key of a fixed category order; unknown values go last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1)).cast("long")


def keyword_filter(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows by column: a scalar means equality, a list means membership."""
    for name, value in wanted.items():
        if name not in df.columns:
            raise ValueError(f"no column {name}; have {df.columns}")
        many = isinstance(value, (list, tuple, set))
        df = df.filter(F.col(name).isin(*value) if many else F.col(name) == value)
    return df


def valid_points(df: DataFrame, t: str, y: str) -> DataFrame:
    """Rows with a finite time and a finite positive value."""
    inf = float("inf")
    return df.filter(
        F.col(t).isNotNull() & ~F.isnan(t) & (F.abs(t) < inf) & F.col(y).isNotNull() & ~F.isnan(y) & (F.col(y) > 0) & (F.col(y) < inf)
    )


def flag(column: Column) -> Column:
    """A missing flag counts as false."""
    return F.coalesce(column, F.lit(False))


def is_runaway(tau: Column, amplitude: Column, *, rule: str = "joint") -> Column:
    """Fits with an unidentifiable plateau; missing values never qualify."""
    if rule == "none":
        return F.lit(False)
    if rule not in ("joint", "tau_only"):
        raise ValueError(f"unknown runaway rule {rule}")
    long_tau = flag(tau > RUNAWAY_TAU_S)
    return long_tau if rule == "tau_only" else long_tau & flag(amplitude >= RUNAWAY_AMPLITUDE)


def gated(df: DataFrame, *, member: Column, passed: Column, runaway: Column) -> DataFrame:
    """Nested gates as columns: candidate, gate_pass, runaway, retained and the subset name."""
    candidate = flag(member)
    gate = candidate & flag(passed)
    bad = gate & flag(runaway)
    subset = (
        F.when(gate & ~bad, "analysed").when(bad, "runaway").when(candidate, "r2_failed")
    )
    return (
        df.withColumn("candidate", candidate)
        .withColumn("gate_pass", gate)
        .withColumn("runaway", bad)
        .withColumn("retained", gate & ~bad)
        .withColumn("subset", subset)
    )


def gate_counts(gated_df: DataFrame, groups: Sequence[str]) -> DataFrame:
    return gated_df.groupBy(*groups).agg(
        F.count_if("candidate").alias("candidates"),
        F.count_if("gate_pass").alias("gate_pass"),
        F.count_if("runaway").alias("runaway"),
        F.count_if("retained").alias("retained"),
    )


def restrict_to(df: DataFrame, accepted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of accepted traces."""
    return df.join(accepted.select(*keys).distinct(), list(keys), "left_semi")


def exclude(df: DataFrame, rejected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of traces that are not rejected."""
    return df.join(rejected.select(*keys).distinct(), list(keys), "left_anti")


def selected_traps(df: DataFrame, selection: DataFrame, experiment: Sequence[str], trap: str, chosen: str) -> DataFrame:
    """Rows of the traps that their experiment selects; ``chosen`` holds its list, NULL or no row meaning all traps."""
    lists = selection.select(*[F.col(e).alias(f"_e_{e}") for e in experiment], F.col(chosen).alias("_chosen"))
    same = [F.col(e) == F.col(f"_e_{e}") for e in experiment]
    keep = F.col("_chosen").isNull() | F.array_contains("_chosen", F.col(trap))
    return df.join(lookup_side(lists), same, "left").filter(keep).drop("_chosen", *[f"_e_{e}" for e in experiment])


def common_traps(df: DataFrame, experiment: Sequence[str], trap: str) -> DataFrame:
    """(trap, experiments, common): in how many experiments each trap occurs, and whether in all of them."""
    seen = df.filter(F.col(trap).isNotNull()).select(*experiment, trap).distinct()
    everywhere = seen.select(*experiment).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = seen.groupBy(trap).agg(F.count(F.lit(1)).alias("experiments"))
    return counted.withColumn("common", F.col("experiments") == everywhere)


def single_common_trap(df: DataFrame, experiment: Sequence[str], trap: str) -> DataFrame:
    """One row: the trap that all experiments share, NULL unless there is exactly one."""
    common = common_traps(df, experiment, trap).filter("common")
    return common.agg(F.when(F.count(F.lit(1)) == 1, F.min(trap)).alias(trap))


def shared_controls(df: DataFrame, *, treatment: str, condition: str, control: str = "ASP") -> DataFrame:
    """Controls limited to treatments that pulsed rows have too; untouched when nothing is pulsed."""
    pulsed = df.filter(F.col(condition) != control).select(F.col(treatment).alias("_t")).distinct()
    n = pulsed.agg(F.count(F.lit(1)).alias("n")).scalar()
    marked = df.join(pulsed, df[treatment] == F.col("_t"), "left").withColumn("_n", n)
    return marked.filter((F.col(condition) != control) | F.col("_t").isNotNull() | (F.col("_n") == 0)).drop("_t", "_n")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the first by ``order``; each task keeps one row per key before any shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Left join to the first matching row of ``right``."""
    return left.join(first_per_key(right, keys, order), list(keys), "left")


def replicate(df: DataFrame, values: Sequence, column: str) -> DataFrame:
    """Each row once per listed value (controls shown under every duration)."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))


def full_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key union of two count tables, zero where a side has no row."""
    joined = left.join(right, list(keys), "full")
    return joined.na.fill(0, [c for c in joined.columns if c not in keys])


def whole_range(df: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    """A count table completed to every integer of lo..hi, zero where absent; keys outside that range stay."""
    span = df.sparkSession.range(lo, hi + 1).select(F.col("id").alias("_k"))
    out = span.join(df, F.col("_k") == F.col(column), "full").withColumn("_k", F.coalesce("_k", F.col(column).cast("long")))
    return out.drop(column).withColumnRenamed("_k", column).na.fill(0)


def blank_unless(value: Column, gate: Column) -> Column:
    """The value, or NULL where the gate fails."""
    return F.when(flag(gate), value)


def varying_columns(df: DataFrame, columns: Sequence[str], *, min_range: float = 1e-9) -> list[str]:
    """Columns with more than one value and a range above ``min_range`` (one pass, one row back)."""
    row = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > min_range]


def first_unique_times(df: DataFrame, keys: Sequence[str], t: str, frame: str) -> DataFrame:
    """One row per (trace, time), the earliest frame kept."""
    return first_per_key(df, [*keys, t], F.col(frame))


def set_difference_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only in the first set, only in the second, and in both (as sets)."""
    cols = left.columns
    both = left.distinct().withColumn("_l", F.lit(1)).join(
        right.select(*cols).distinct().withColumn("_r", F.lit(1)), cols, "full"
    )
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("only_first"),
        F.count_if(F.col("_l").isNull()).alias("only_second"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("common"),
    )


def pool_with_total(df: DataFrame, groups: Sequence[str], aggs: Mapping[str, Column], *, total: str = "All") -> DataFrame:
    """Aggregates per group and over all groups of the last key, in one rollup."""
    *outer, last = groups
    sets = [[*outer, last], list(outer)]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in groups]).agg(
        F.grouping(last).alias("_g"), *[a.alias(n) for n, a in aggs.items()]
    )
    return out.withColumn(last, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(last).cast("string"))).drop("_g")


def last_rows(df: DataFrame, keys: Sequence[str], n: int, *, frame: str = "frame", n_rows: str = "n_rows") -> DataFrame:
    """Last ``n`` rows of each trace, from the frame number and the trace length."""
    return df.filter(F.col(frame) >= F.col(n_rows) - n)


def first_rows(df: DataFrame, n: int, *, frame: str = "frame") -> DataFrame:
    return df.filter(F.col(frame) < n)
