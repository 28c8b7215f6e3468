"""Exact linear-interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraces.operators.stage import lookup_side, staged

#: Rows of a group that one task orders, and distinct values that it orders of a longer one.
ORDERED_ROWS = 100_000
#: Parts into which a bracket is counted at a time.
BINS = 4096


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    count: str | None = None,
    ordered_rows: int = ORDERED_ROWS,
) -> DataFrame:
    """One row per group with the exact quantiles named in ``probs``; NULLs are skipped.

    Groups of up to ``ordered_rows`` rows are ordered, all their quantiles at once. Of a longer one each quantile has a
    bracket, the whole range at first. The rows inside it are counted in equal parts, and the part that holds the wanted rank
    becomes the bracket, until it holds no more than ``ordered_rows`` distinct values. So no task orders more than that,
    and a bracket that is one value needs no ordering.
    """
    groups = list(groups)
    v = F.col(value).cast("double")
    rows = df.select(*groups, v.alias("_v")).filter(F.col("_v").isNotNull())
    if not groups:
        rows = rows.withColumn("_all", F.lit(0))
    by = groups or ["_all"]
    sizes = lookup_side(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    long = sizes.filter(F.col("_n") > ordered_rows)
    if long.isEmpty():
        out = _ordered(rows, by, probs)
    else:
        long = lookup_side(long)
        out = _ordered(rows.join(long.select(*by), by, "left_anti"), by, probs).unionByName(_narrowed(rows, by, probs, long, ordered_rows))
    out = out.withColumnRenamed("_n", count) if count else out.drop("_n")
    return out if groups else out.drop("_all")


def _between(low: Column, high: Column, pos: Column) -> Column:
    return low + (high - low) * (pos - F.floor(pos))


def _ordered(rows: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """(by, quantiles, _n) of groups that one task each can order."""
    whole = Window.partitionBy(*by)
    ranked = rows.withColumn("_r", F.row_number().over(whole.orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))

    def at(p: float) -> Column:
        pos = F.lit(p) * (F.col("_n") - 1)
        low, high = (F.max(F.when(F.col("_r") == edge(pos), F.col("_v"))) for edge in (F.floor, F.ceil))
        return _between(low, high, F.lit(p) * (F.max("_n") - 1))

    return ranked.groupBy(*by).agg(*[at(p).alias(n) for n, p in probs.items()], F.max("_n").alias("_n"))


def _narrowed(rows: DataFrame, by: Sequence[str], probs: Mapping[str, float], long: DataFrame, ordered_rows: int) -> DataFrame:
    """(by, quantiles, _n) of long groups, by closing in on the two ranks around each quantile."""
    rows = staged(rows.join(long.select(*by), by, "left_semi"))
    ranks = [F.struct(F.lit(2 * i + j).alias("i"), edge(F.lit(p) * (F.col("_n") - 1)).cast("long").alias("at")) for i, p in enumerate(probs.values()) for j, edge in enumerate((F.floor, F.ceil))]
    # one bracket for each wanted rank; ``below`` rows lie under it
    open_ = long.select(*by, F.explode(F.array(*ranks)).alias("_q"), F.lit(0).cast("long").alias("below"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    open_ = staged(open_.select(*by, "_q.*", "below", "lo", "hi"))
    found: DataFrame | None = None
    while True:
        same = open_.filter("lo = hi").select(*by, "i", F.col("lo").alias("q"))
        found = same if found is None else found.unionByName(same)
        open_ = open_.filter("lo < hi")
        if open_.isEmpty():
            break
        inside = rows.join(lookup_side(open_), by).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        share = F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        part = F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo"))) * BINS))
        counted = inside.groupBy(*by, "i", "at", "below", part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.approx_count_distinct("_v").alias("distinct")
        )
        along = Window.partitionBy(*by, "i").orderBy("part")
        counted = counted.withColumn("until", F.col("below") + F.sum("n").over(along))
        hit = counted.filter((F.col("until") > F.col("at")) & (F.col("until") - F.col("n") <= F.col("at")))
        hit = staged(hit.select(*by, "i", "at", (F.col("until") - F.col("n")).alias("below"), "lo", "hi", "distinct"))
        few = hit.filter((F.col("distinct") <= ordered_rows / 2) & (F.col("lo") < F.col("hi"))).drop("distinct")
        values = rows.join(lookup_side(few), by).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        values = values.groupBy(*by, "i", "at", "below", "_v").agg(F.count(F.lit(1)).alias("n"))
        values = values.withColumn("until", F.col("below") + F.sum("n").over(Window.partitionBy(*by, "i").orderBy("_v")))
        found = found.unionByName(values.groupBy(*by, "i").agg(F.min(F.when(F.col("until") > F.col("at"), F.col("_v"))).alias("q")))
        open_ = staged(hit.filter((F.col("distinct") > ordered_rows / 2) | (F.col("lo") == F.col("hi"))).drop("distinct"))
    found = found.join(long.select(*by, "_n"), list(by))
    picked = {i: F.max(F.when(F.col("i") == i, F.col("q"))) for i in range(2 * len(probs))}
    return found.groupBy(*by).agg(
        *[_between(picked[2 * i], picked[2 * i + 1], F.lit(p) * (F.max("_n") - 1)).alias(n) for i, (n, p) in enumerate(probs.items())],
        F.max("_n").alias("_n"),
    )
