"""Proportional stratified interleaving: every shard is a slice of the corpus with the mixture of the whole.

Rows are shuffled by a seeded digest within their source and ranked; the fractional rank (rank - 1/2) / n
orders all rows, and equal cuts of that order are the shards. Both rankings go through buckets: counts per
bucket are summed before the buckets, and rows are numbered inside one bucket only, so neither a hot source
nor the global order ever meets in one task. Only DataFrame functions are used.

Defined results. A null text has size 1 and checksum null is reported as that of the empty text. A null source
is a stratum. Null ids and repeated rows are ranked like others; rows that agree in all named columns are
interchangeable. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraces.operators.stage import staged

#: Rows that a ranking bucket holds on average; a balance between windows and bucket table, not a limit.
BUCKET_ROWS = 512


def unit_digest(key: Column, seed: int) -> tuple[Column, Column]:
    """The digest of a key under a seed, and its first 52 bits as a number in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit("null"))))
    return digest, F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def ranked_in_buckets(rows: DataFrame, groups: list[str], bucket: str, order: list[Column | str], name: str) -> DataFrame:
    """Rank from 1 of each row within its groups, where ``bucket`` already follows the wanted order.

    The bucket counts are aggregated before the shuffle; their running sum has a row per bucket. With no
    group the running sum itself goes through blocks of 1,024 buckets.
    """
    block = (F.col(bucket) / 1024).cast("long")
    counts = rows.groupBy(*groups, bucket).agg(F.count("*").alias("_n")).withColumn("_block", block)
    blocks = counts.groupBy(*groups, "_block").agg(F.sum("_n").alias("_block_n"))
    over_blocks = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(g).alias(f"_b_{g}") for g in groups], F.col("_block").alias("_b_block"), F.coalesce(F.sum("_block_n").over(over_blocks), F.lit(0)).alias("_earlier"))
    same_block = F.col("_block") == F.col("_b_block")
    for g in groups:
        same_block = same_block & F.col(g).eqNullSafe(F.col(f"_b_{g}"))
    inside = Window.partitionBy(*groups, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(blocks, same_block)
    offsets = offsets.select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col(bucket).alias("_o_bucket"), (F.col("_inside") + F.col("_earlier")).alias("_offset"))
    same = F.col(bucket) == F.col("_o_bucket")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order)))
    found = numbered.join(offsets, same).withColumn(name, F.col("_row") + F.col("_offset"))
    return found.drop("_row", "_offset", "_o_bucket", *[f"_o_{g}" for g in groups])


def stratified_shards(
    docs: DataFrame,
    *,
    shards: int = 8,
    seed: int = 29,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Each document with (size, text_crc32, shard, slot); shard row counts differ by one at most.

    The text is read once, for its size and checksum, and never shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest, unit = unit_digest(F.concat_ws("|", F.col(id_col).cast("string"), F.crc32(text).cast("string")), seed)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("stratum"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        digest.alias("digest"),
        unit.alias("unit"),
    )
    rows = staged(rows)
    total = rows.count()
    buckets = max(1, total // BUCKET_ROWS)
    ties: list[Column | str] = ["digest", F.col("doc_id").asc_nulls_first(), "text_crc32", "size"]
    rows = rows.withColumn("bucket", F.least(F.floor(F.col("unit") * buckets), F.lit(buckets - 1)).cast("long"))
    rows = ranked_in_buckets(rows, ["stratum"], "bucket", ties, "rank")
    sizes = rows.groupBy(F.col("stratum").alias("of")).agg(F.count("*").alias("in_stratum"))
    rows = rows.join(sizes, F.col("stratum").eqNullSafe(F.col("of"))).drop("of", "bucket")
    rows = rows.withColumn("place", (F.col("rank") - 0.5) / F.col("in_stratum"))
    rows = rows.withColumn("bucket", F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1)).cast("long"))
    rows = ranked_in_buckets(rows, [], "bucket", ["place", F.col("stratum").asc_nulls_last(), "rank"], "position")
    zero_based = F.col("position") - 1
    shard = F.floor((F.lit(shards) * F.col("position") - 1) / F.lit(max(1, total)))
    start = F.floor(shard * F.lit(total) / F.lit(shards))
    return rows.select("doc_id", F.col("stratum").alias("source"), "size", "text_crc32", shard.cast("int").alias("shard"), (zero_based - start).cast("long").alias("slot"))
