"""Ensembles at several levels of grouping at once, from one interpolation.

Points are reduced once to moments of the finest groups. The moments, not the points, are then merged upwards to every level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraces.operators.resample import needed

#: Stands in a dimension over which a level does not distinguish.
ANY = "*"


def _levels(df: DataFrame, dims: Sequence[str], levels: Sequence[Sequence[str]], rest: Sequence[str], *aggs) -> DataFrame:
    """Aggregates at each level; dimensions become text, with ``ANY`` where the level leaves them out."""
    sets = [[F.col(c) for c in (*level, *rest)] for level in levels]
    out = df.groupingSets(sets, *[F.col(c) for c in (*dims, *rest)]).agg(*[F.grouping(d).alias(f"_g_{d}") for d in dims], *aggs)
    named = {d: F.when(F.col(f"_g_{d}") == 1, F.lit(ANY)).otherwise(F.col(d).cast("string")) for d in dims}
    return out.withColumns(named).drop(*[f"_g_{d}" for d in dims])


def level_ensembles(
    points: DataFrame, keys: Sequence[str], dims: Sequence[str], levels: Sequence[Sequence[str]], *, value: str = "value", index: str = "i",
    grid: str = "grid", share: float = 0.25, rule: str = "ceil", min_traces: int = 3,
) -> DataFrame:
    """(dims, i, grid, mean, sd, sem, n, traces, aggregate_ok) for every level, a list of some of ``dims``.

    ``points`` holds (keys, dims, i, grid, value); a trace with no value at any point counts as none. Population SD; grid
    points to which too few traces of their group contribute are left out.
    """
    dims = list(dims)
    # moments of the finest groups: count, sum, and squares about their own mean
    finest = points.groupBy(*dims, index).agg(
        F.max(grid).alias(grid), F.count(value).alias("_n"), F.sum(value).alias("_s"), (F.var_pop(value) * F.count(value)).alias("_m2")
    ).filter("_n > 0")
    about_zero = F.col("_m2") + F.col("_s") * F.col("_s") / F.col("_n")
    merged = _levels(finest, dims, levels, [index], F.max(grid).alias(grid), F.sum("_n").alias("n"), F.sum("_s").alias("_s"), F.sum(about_zero).alias("_q"))
    mean = F.col("_s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0)))
    merged = merged.withColumn("mean", mean).withColumn("sd", sd).withColumn("sem", F.col("sd") / F.sqrt("n")).drop("_s", "_q")
    traces = points.filter(F.col(value).isNotNull()).groupBy(*dims, *[k for k in keys if k not in dims]).agg(F.lit(1).alias("_one"))
    sizes = _levels(traces, dims, levels, [], F.count(F.lit(1)).alias("traces")).select(*[F.col(d).alias(f"_s_{d}") for d in dims], "traces")
    same = None
    for d in dims:
        one = F.col(d).eqNullSafe(F.col(f"_s_{d}"))
        same = one if same is None else same & one
    return (
        merged.join(sizes, same)
        .drop(*[f"_s_{d}" for d in dims])
        .filter(F.col("n") >= needed(F.col("traces"), share, rule))
        .withColumn("aggregate_ok", F.col("traces") >= min_traces)
    )
