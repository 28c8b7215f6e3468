"""The corpus pipeline: stages over the documents table, each of them one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All stages but the last return the columns that
they were given. Rows with nulls, empty texts or repeats are treated as the operator of the stage defines; an empty table
passes through as an empty table. Stages with Python workers bound the Arrow batches of their session (`bounded_batches`).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktraces.llm.bpe import decoded, encoded
from sparktraces.llm.jaccard_join import one_per_component
from sparktraces.llm.mixing import mixed
from sparktraces.llm.toxicity import fitted, kept
from sparktraces.operators.stage import bounded_batches, staged

VOCABULARY = "byte_bpe_50k.json"
#: Fragments that a task keeps, fewer than by default, as the stages share the memory of an executor.
KEPT_FRAGMENTS = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier does not reject."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kept(docs, fitted(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 hold together."""
    bounded_batches(spark)
    return one_per_component(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources wants it."""
    return mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row: the token ids, and the digest of what they decode to.

    The ids are written in between, so a task has one Python process, and not an encoder and a decoder side by side.
    """
    bounded_batches(spark)
    vocabulary = public_tokenizers.path(VOCABULARY)
    tokens = decoded(staged(encoded(docs, vocabulary, kept=KEPT_FRAGMENTS)), vocabulary)
    return tokens.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", tokenize),
]

#: The stages learn, cluster and tokenise, which SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
