"""Writers.  Parquet, partitioned by low-cardinality columns; nothing is collected."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktraces.operators.sequence import attach, without_chunks

# Column order of exported traces.
IDENTITY = [
    "experiment", "trap_id", "date", "cell_type", "treatment", "chip", "experiment_number", "pressure_pa",
    "voltage_v", "duration_ms", "duration_label", "pulse_frame", "condition_type", "fate_status",
]
TIME_AXES = ["frame", "time_s", "elapsed_s", "marker_s", "entry_s"]


def ordered(df: DataFrame) -> DataFrame:
    """Identity columns, then time axes, then data."""
    head = [c for c in [*IDENTITY, *TIME_AXES] if c in df.columns]
    return df.select(*head, *[c for c in without_chunks(df).columns if c not in head])


def write_traces(df: DataFrame, root: str) -> None:
    """Long traces, one partition folder per channel."""
    ordered(df).write.mode("overwrite").partitionBy("channel").parquet(f"{root}/traces")


def rejected_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str], t: str) -> DataFrame:
    """(trace, column, reason) for columns without values or with gaps, and for traces without times."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count(t).alias("_t"), *[F.count(c).alias(f"_c_{c}") for c in columns]
    )
    checks = [
        F.when(F.col("_t") == 0, F.struct(F.lit(t).alias("column"), F.lit("no time column").alias("reason"))),
        *[
            F.when(
                F.col(f"_c_{c}") < F.col("_n"),
                F.struct(
                    F.lit(c).alias("column"),
                    F.when(F.col(f"_c_{c}") == 0, "no values").otherwise("wrong length").alias("reason"),
                ),
            )
            for c in columns
        ],
    ]
    return counts.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("_r")).select(*keys, "_r.*")


def write_bundle(tables: Mapping[str, DataFrame], root: str) -> None:
    """Each non-empty table under its name."""
    for name, df in tables.items():
        if not df.isEmpty():
            ordered(df).write.mode("overwrite").parquet(f"{root}/{name}")


MANIFEST = "current.json"


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def committed(spark: SparkSession, root: str) -> dict[str, str]:
    """Name -> path of the tables of the last commit under ``root``; none before the first one."""
    system, manifest = _system(spark, f"{root}/{MANIFEST}")
    if not system.exists(manifest):
        return {}
    row = spark.read.json(f"{root}/{MANIFEST}").first()
    return {name: f"{root}/{row['version']}/{name}" for name in row["tables"]}


def commit_bundle(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, *, partitions: Mapping[str, Sequence[str]] | None = None) -> str:
    """Writes all tables, then shows them to readers at once; gives the version.

    Each commit is a folder of its own, so a job that fails leaves the last one as it was. The manifest, one small file, is
    replaced by a rename when every table is there. Versions that it no longer names are deleted. Empty tables are left out.
    """
    version = f"v-{uuid.uuid4().hex}"
    written = []
    for name, df in tables.items():
        if df.isEmpty():
            continue
        writer = ordered(df).write
        by = (partitions or {}).get(name)
        (writer.partitionBy(*by) if by else writer).parquet(f"{root}/{version}/{name}")
        written.append(name)
    system, folder = _system(spark, root)
    ready = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{MANIFEST}-{version}")
    out = system.create(ready, True)
    out.write(bytearray((json.dumps({"version": version, "tables": written}) + "\n").encode()))
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, MANIFEST)
    system.delete(target, False)
    system.rename(ready, target)
    for found in system.listStatus(folder):
        name = found.getPath().getName()
        if name.startswith("v-") and name != version:
            system.delete(found.getPath(), True)
    return version


def read_committed(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last commit."""
    return {name: spark.read.parquet(path) for name, path in committed(spark, root).items()}


def analysis_tables(**tables: DataFrame) -> dict[str, DataFrame]:
    """The analysis tables of a run (kinetics, sweep, fates, ...) for `commit_bundle`, without layout columns."""
    return {name: without_chunks(df) for name, df in tables.items()}


def up_to_event(df: DataFrame, event: str, *, frame: str = "frame") -> DataFrame:
    """The filtered detection table: rows up to and including the event row."""
    return df.filter(F.col(frame) <= F.coalesce(F.col(event), F.col(frame)))


def write_detection(df: DataFrame, event: str, root: str) -> None:
    ordered(df).write.mode("overwrite").parquet(f"{root}/detection_full")
    ordered(up_to_event(df, event)).write.mode("overwrite").parquet(f"{root}/detection_filtered")


def kymograph_long(profiles: DataFrame, keys: Sequence[str], profile: str, *, scale: float = 1.0, width: int | None = None) -> DataFrame:
    """Array profiles as (keys, position, position_um, intensity); short rows are padded with NULL to ``width``."""
    cells = F.col(profile)
    if width is not None:
        cells = F.concat(cells, F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), F.lit(width) - F.size(cells))))
    return (
        profiles.select(*keys, F.posexplode_outer(cells).alias("position", "intensity"))
        .withColumn("position_um", F.col("position") * F.lit(scale))
    )


def kymograph_wide(long: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Back to one column per position."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("position") == i, F.col("intensity"))).alias(f"x{i}") for i in range(width)]
    )


def split_by_check(df: DataFrame, excluded: Column) -> dict[str, DataFrame]:
    """The feature table three ways: all, excluded and kept."""
    bad = F.coalesce(excluded, F.lit(False))
    return {"all": df, "excluded": df.filter(bad), "kept": df.filter(~bad)}


def with_fit(df: DataFrame, fits: DataFrame, keys: Sequence[str], *, frame: str = "frame") -> DataFrame:
    """Traces with their fit parameters on every row; ``fits`` comes from a `summarise`d trace table."""
    return attach(df, fits, keys, frame=frame)


def write_by(df: DataFrame, root: str, *partitions: str) -> None:
    """A table laid out in folders by the given columns."""
    without_chunks(df).write.mode("overwrite").partitionBy(*partitions).parquet(root)


def write_folders(df: DataFrame, root: str) -> None:
    """Trace files with a header, one folder per experiment."""
    without_chunks(df).write.mode("overwrite").partitionBy("experiment").option("header", "true").csv(root)
