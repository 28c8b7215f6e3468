"""What the vector searches share: which vectors take part, the query set, and the best of partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraces.operators.stage import staged


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def query_set(vectors: DataFrame, every: int) -> DataFrame:
    """(query_id, query) of the rows whose id is divisible by ``every``; an id in several rows has its least vector."""
    chosen = vectors.filter(F.col("vec_id") % every == 0)
    return chosen.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query"))


def dealt(name: str, key: str, parts: int) -> Column:
    """A number below ``parts`` for each row, by a digest of its key."""
    return F.pmod(F.xxhash64(key, F.lit(name)), F.lit(parts)).cast("int")


def best(found: DataFrame, k: int, *, largest: bool) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query, ties to the smaller id."""
    score = F.col("score").desc() if largest else F.col("score").asc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def width_of(vectors: DataFrame) -> int:
    """The commonest length of the vectors, the smaller of equals; 0 without vectors."""
    row = vectors.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return row["w"] if row else 0


def prepared(rows: DataFrame, id_col: str, vector_col: str, component=lambda x: x, extra: Column | None = None) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, staged, and their width; vectors of another width take no part."""
    vector = F.col(vector_col)
    good = usable(vector) if extra is None else usable(vector) & extra
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), good.alias("good"))
    kept = kept.filter("good and vec_id is not null").select("vec_id", F.transform("vector", component).alias("vector"))
    kept = staged(kept)
    width = width_of(kept)
    return kept.filter(F.size("vector") == width), width
