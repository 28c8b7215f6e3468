"""Registered queries of the operators, with their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktraces.llm.ann_tree import nearest
from sparktraces.llm.bpe import decoded, encoded
from sparktraces.llm.chat import perspectives
from sparktraces.llm.hard_negatives import hard_negatives
from sparktraces.llm.html_extract import extracted
from sparktraces.llm.impact_topk import impact_topk
from sparktraces.llm.jaccard_join import jaccard_components
from sparktraces.llm.mixing import mix_plan
from sparktraces.llm.sharding import stratified_shards
from sparktraces.llm.token_counts import token_counts
from sparktraces.llm.toxicity import CUTOFF, fitted, scored
from sparktraces.llm.url_filter import Rule, judged
from sparktraces.llm.whitening import whitened
from sparktraces.plans.registry import Run, table

QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def llm_query(name: str, sql: str | None = None):
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


#: Name of the vocabulary file among the installed public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


@llm_query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(VOCABULARY)
    tokens = decoded(encoded(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


CHAT_SQL = """
WITH r AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker IS NOT NULL AND speaker <> 'system'),
s AS (
  SELECT r.*, p.perspective, md5(coalesce(r.speaker, '') || '|' || r.said) AS digest,
    CASE WHEN r.speaker = p.perspective THEN '<|assistant|>\n' WHEN r.speaker = 'system' THEN '<|system|>\n'
      WHEN r.speaker IS NULL THEN '<|user|>\n' ELSE '<|user:' || r.speaker || '|>\n' END AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, head || said || '<|end|>\n' AS piece,
    CAST(sum(length(head || said || '<|end|>\n')) OVER (PARTITION BY conv_id, perspective
      ORDER BY turn NULLS FIRST, digest, speaker NULLS FIRST, said ROWS UNBOUNDED PRECEDING) AS BIGINT) AS finish
  FROM s)
SELECT conv_id, perspective, turn, speaker, piece, finish - length(piece) AS begin, finish,
  CASE WHEN speaker = perspective THEN finish - length(piece) + length(head) END AS learn_begin,
  CASE WHEN speaker = perspective THEN finish END AS learn_end
FROM o
"""


@llm_query("op2_perspectives", CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


@llm_query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


@llm_query("op4_main_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@llm_query("op5_stratified_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@llm_query("op6_kmeans_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


@llm_query("op7_toxicity_cnn")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "threshold")


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@llm_query("op8_impact_topk", TOPK_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk(table(spark, sf_dir, "embeddings"), k=5, every=50)


MIX_SQL = r"""
WITH words AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('11:0:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS m0,
    md5('11:1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS m1
  FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM words GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS pos FROM sized),
stops AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(pos % 3 + 1 AS INTEGER)] AS weight, 3.0::DOUBLE * source_size AS stop FROM ranked),
filled AS (
  SELECT *,
    coalesce(sum(stop) OVER (ORDER BY stop / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS full_before,
    coalesce(sum(weight) OVER (ORDER BY stop / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS weight_before,
    CAST(sum(source_size) OVER () AS DOUBLE) AS all_words, sum(weight) OVER () AS all_weight
  FROM stops),
levels AS (
  SELECT *, CASE WHEN stop > (all_words - full_before) / (all_weight - weight_before) * weight
    THEN (all_words - full_before) / (all_weight - weight_before) END AS own FROM filled),
firsts AS (
  SELECT *, first_value(own IGNORE NULLS) OVER (ORDER BY stop / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lvl FROM levels),
goals AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN stop ELSE lvl * weight END AS target FROM firsts),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM goals),
drawn AS (
  SELECT w.doc_id, w.source, w.size, r.source_size, r.target, floor(r.rate) AS whole, r.rate - floor(r.rate) AS part, k.n,
    CAST('0x' || substr(CASE WHEN k.n < 4 THEN m0 ELSE m1 END, CAST(8 * (k.n % 4) + 1 AS INTEGER), 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM words w JOIN rates r ON w.source IS NOT DISTINCT FROM r.source, range(8) k(n)),
tried AS (
  SELECT source, n, abs(sum(CASE WHEN u < part THEN size ELSE 0 END) + any_value(whole) * any_value(source_size) - any_value(target)) AS miss
  FROM drawn GROUP BY source, n),
chosen AS (SELECT source, min(n) AS n FROM (SELECT *, min(miss) OVER (PARTITION BY source) AS best FROM tried) WHERE miss = best GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST(d.size * (d.whole + CASE WHEN d.u < d.part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.n = c.n
"""


@llm_query("op9_source_mix", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("mix_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@llm_query("op10_redirect_equivalence")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


#: Name of the model file among the installed public tokenizers.
PIECES = "piece_bpe_32k.model"


@llm_query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), limit=4096)


@llm_query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), components=8)


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""


@llm_query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, every=100, positives=5, negatives=10, low_percent=30, high_percent=90)
