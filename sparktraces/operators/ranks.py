"""Average ranks and the statistics built on them.

Ties collapse to one row per distinct value before any ordering. A table with more distinct values than one task should order
is cut by ranges of (group, value) that hold about as many of them each, whatever the values look like.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraces.operators.quantiles import quantiles
from sparktraces.operators.stage import staged

BUCKET_ROWS = 65_536


def ranged(counts: DataFrame, order: Sequence[str], rows: int, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The ``rows`` rows of a table with ``_bucket``, which never falls along ``order`` and holds about ``bucket_rows`` of them.

    The cuts come from a sample of the rows themselves, so neither an outlier nor a hot group fills a bucket. The table is
    written, so the buckets stay what they are if a task runs again.
    """
    placed = counts.repartitionByRange(math.ceil(rows / bucket_rows), *order)
    return staged(placed.withColumn("_bucket", F.spark_partition_id()))


def rank_table(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    *,
    weight: str | None = None,
    rank: str = "rank",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(groups, value, ties, rank, n): the average rank of each distinct value.

    ``weight`` names a column holding how many equal rows a row stands for.
    """
    groups = list(groups)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = staged(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(amount.alias("ties")))
    distinct = counts.count()

    def finished(rows: DataFrame, before: Column) -> DataFrame:
        return rows.select(*groups, value, "ties", (before + F.col("_cum") - (F.col("ties") - 1) / F.lit(2.0)).alias(rank), "n")

    if distinct <= bucket_rows:
        whole = Window.partitionBy(*groups)
        rows = counts.withColumn("_cum", F.sum("ties").over(whole.orderBy(value))).withColumn("n", F.sum("ties").over(whole))
        return finished(rows, F.lit(0))
    placed = ranged(counts, [*groups, value], distinct, bucket_rows=bucket_rows)
    totals = placed.groupBy(*groups, "_bucket").agg(F.sum("ties").alias("_t"))
    along = Window.partitionBy(*groups)
    offsets = totals.select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_t").over(along.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_t").over(along).alias("n"),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value)
    return finished(placed.withColumn("_cum", F.sum("ties").over(inside)).join(offsets, [*groups, "_bucket"]), F.col("_offset"))


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, *, rank: str = "rank") -> DataFrame:
    """Rows of ``df`` with their average rank inside the group (NULL values drop out)."""
    table = rank_table(df, groups, value, rank=rank).drop("ties", "n")
    return df.join(table, [*groups, value])


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str, *, min_n: int = 3) -> DataFrame:
    """Spearman rho per group on rows where both values are present.

    Returns (groups, n, rho, t_stat); rho is NULL below ``min_n`` rows or when a
    side is constant.  ``t_stat`` is rho * sqrt((n - 2) / (1 - rho^2)).
    """
    groups = list(groups)
    pairs = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*groups, F.col(x).alias("_x"), F.col(y).alias("_y"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    rx = rank_table(pairs, groups, "_x", weight="_w", rank="_rx").drop("ties")
    ry = rank_table(pairs, groups, "_y", weight="_w", rank="_ry").drop("ties", "n")
    mid = (F.col("n") + 1) / F.lit(2.0)
    dx, dy, w = F.col("_rx") - mid, F.col("_ry") - mid, F.col("_w")
    sums = (
        pairs.join(rx, [*groups, "_x"])
        .join(ry, [*groups, "_y"])
        .groupBy(*groups)
        .agg(
            F.max("n").alias("n"),
            F.sum(w * dx * dy).alias("_xy"),
            F.sum(w * dx * dx).alias("_xx"),
            F.sum(w * dy * dy).alias("_yy"),
        )
    )
    rho = F.when(
        F.col("n") >= min_n,
        F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))),
    )
    return (
        sums.withColumn("rho", rho)
        .withColumn(
            "t_stat",
            F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho"))),
        )
        .select(*groups, F.col("n").cast("long").alias("n"), "rho", "t_stat")
    )


def two_sample_ranks(
    df: DataFrame, panels: Sequence[str], arm: str, value: str, first: str, second: str, *, min_n: int = 1
) -> DataFrame:
    """Mann-Whitney U (of ``first``), tie-corrected z and Cliff's delta per panel.

    z carries the 0.5 continuity correction; delta is 2U/(n1 n2) - 1, which needs
    no list of pairs.  Panels where an arm has fewer than ``min_n`` rows give NULL.
    """
    panels = list(panels)
    rows = df.filter(F.col(arm).isin(first, second) & F.col(value).isNotNull())
    if not panels:
        rows = rows.withColumn("_all", F.lit(0))
    by = panels or ["_all"]
    arms = rows.groupBy(*by, value).agg(
        F.count_if(F.col(arm) == first).alias("_a"),
        F.count_if(F.col(arm) == second).alias("_b"),
    )
    table = rank_table(
        arms.withColumn("_w", F.col("_a") + F.col("_b")), by, value, weight="_w"
    )
    sums = (
        arms.join(table, [*by, value])
        .groupBy(*by)
        .agg(
            F.sum("_a").alias("n1"),
            F.sum("_b").alias("n2"),
            F.sum(F.col("_a") * F.col("rank")).alias("_r1"),
            F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("_tie"),
        )
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    enough = (n1 >= min_n) & (n2 >= min_n)
    u = F.when(enough, F.col("_r1") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_tie"), n * (n - 1))))
    mean = n1 * n2 / 2
    shifted = F.greatest(F.abs(F.col("u") - mean) - 0.5, F.lit(0.0)) * F.signum(F.col("u") - mean)
    out = (
        sums.withColumn("u", u)
        .withColumn("z", F.try_divide(shifted, spread))
        .withColumn("cliffs_delta", F.try_divide(2 * F.col("u"), n1 * n2) - 1)
        .select(*by, "n1", "n2", "u", "z", "cliffs_delta")
    )
    return out if panels else out.drop("_all")


def kruskal_wallis(df: DataFrame, panels: Sequence[str], level: str, value: str) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H across the levels of each panel, with its degrees of freedom."""
    panels = list(panels)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*panels, level, value)
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    table = rank_table(counts, panels, value, weight="_w")
    per_level = (
        counts.join(table, [*panels, value])
        .groupBy(*panels, level)
        .agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("rank")).alias("_r"), F.max("n").alias("n"))
    )
    ties = table.groupBy(*panels).agg(
        F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("_tie")
    )
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    return (
        per_level.groupBy(*panels)
        .agg(
            F.count(F.lit(1)).alias("levels"),
            F.max("n").alias("n"),
            F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"),
        )
        .join(ties, panels)
        .select(
            *panels,
            "levels",
            "n",
            F.try_divide(raw, 1 - F.col("_tie") / (n * n * n - n)).alias("h"),
        )
    )


def wilcoxon_signed_rank(df: DataFrame, groups: Sequence[str], before: str, after: str, *, min_n: int = 5) -> DataFrame:
    """Paired signed-rank sums: W+, W-, n of non-zero differences, tie-corrected z, and the median of all differences."""
    groups = list(groups)
    pairs = df.select(*groups, (F.col(after) - F.col(before)).alias("_d")).filter(F.col("_d").isNotNull())
    middle = quantiles(pairs, groups, "_d", {"median_difference": 0.5})
    diffs = (
        pairs.filter(F.col("_d") != 0)
        .groupBy(*groups, F.abs("_d").alias("_abs"))
        .agg(
            F.count_if(F.col("_d") > 0).alias("_up"),
            F.count(F.lit(1)).alias("_w"),
        )
    )
    table = rank_table(diffs, groups, "_abs", weight="_w")
    sums = (
        diffs.join(table, [*groups, "_abs"])
        .groupBy(*groups)
        .agg(
            F.max("n").alias("n"),
            F.sum(F.col("_up") * F.col("rank")).alias("w_plus"),
            F.sum((F.col("_w") - F.col("_up")) * F.col("rank")).alias("w_minus"),
            F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("_tie"),
        )
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(var))
    out = sums.select(*groups, "n", "w_plus", "w_minus", F.when(F.col("n") >= min_n, z).alias("z"))
    return out.join(middle, groups) if groups else out.withColumn("median_difference", middle.scalar())
