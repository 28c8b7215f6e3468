"""Writes an intermediate result once, so that later steps read it instead of repeating its plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Bytes of a batch that goes to a Python worker, where the session does not set them.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Paths handed out by this process and not released yet.
_created: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="sparktraces-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the staging folder."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    _created.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes what was staged after the first ``since`` paths; results that still read them must be done with."""
    gone = _created[since:]
    for path in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    del _created[since:]
    return len(gone)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged inside, also where it fails."""
    before = len(_created)
    try:
        yield
    finally:
        release(spark, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `staged` returned, before the scope ends; nothing may read them any more."""
    for table in tables:
        names = {file.rsplit("/", 2)[-2] for file in table.inputFiles()}
        for path in [p for p in _created if p.rsplit("/", 1)[-1] in names]:
            target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
            _created.remove(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on Python workers of the session get Arrow batches of about `BATCH_BYTES`, unless it sets their size itself.

    By default a batch holds 64 MB or 10,000 rows, often all texts of a task. An executor keeps some copies of a batch for each
    of its tasks, outside its heap. The setting stays, as a result may run after the step that made it has returned.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def staged(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table in the staging folder."""
    path = staging_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_side(df: DataFrame, *, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table for the small side of a join, written once and counted.

    Up to ``limit`` rows it carries a broadcast hint, so the large side is not
    shuffled; beyond that Spark picks the join, and splits hot keys at run time.
    """
    table = staged(df)
    return F.broadcast(table) if table.count() <= limit else table
