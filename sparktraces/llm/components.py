"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraces.operators.stage import staged


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = _least_neighbour(edges).select(F.col("u").alias("k"), "m")
    tied = edges.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for every node that occurs in an edge; the component is its least node.

    Nodes may be numbers or strings. Self loops and repeated edges are allowed; edges with a null end are
    left out. The minimum per node is pre-aggregated and every round is written to the shared staging folder,
    so neither a hot node nor a lost executor stops it. Rounds grow with the logarithm of the longest chain.
    """
    ends = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null")
    loops = staged(ends.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    now = staged(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(now)
    while seen[0]:
        now = staged(_small_star(_large_star(now)))
        found = _digest(now)
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("u").alias("k"), F.col("v").alias("root"))
    return loops.join(roots, F.col("node") == F.col("k"), "left").select("node", F.coalesce("root", "node").alias("component"))
