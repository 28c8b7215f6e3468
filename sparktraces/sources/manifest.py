"""Tables of files: discovery, channels, order and time stamps, without opening the files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktraces.functions.labels import frame_number, parse_folder
from sparktraces.operators.sequence import number_rows

# File-name time patterns in the order they are tried.
TIME_PATTERNS = {
    "dashed": r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})",
    "compact": r"(\d{8}_\d{6})",
    "milliseconds": r"_t(\d+)ms",
    "seconds": r"_(\d+)s_",
}


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, folder, name, length) of every file below ``root`` whose name matches ``glob``."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    parts = F.split(F.col("path"), "/")
    return found.select(
        "path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "length"
    )


def experiments(manifest: DataFrame) -> DataFrame:
    """One row per folder that follows the grammar, with its parsed fields."""
    return (
        manifest.select(F.col("folder").alias("experiment"))
        .distinct()
        .withColumn("_f", parse_folder(F.col("experiment")))
        .filter(F.col("_f").isNotNull())
        .select("experiment", "_f.*")
    )


def trap_number(name: Column) -> Column:
    """Integer after 'trap_' in a file name, padded or not, in any case."""
    return F.nullif(F.regexp_extract(name, r"(?i)trap_(\d+)", 1), F.lit("")).cast("int")


def preferred_side_files(manifest: DataFrame) -> DataFrame:
    """One side file per (folder, trap): the padded spelling wins over the unpadded one."""
    rows = manifest.withColumn("trap_id", trap_number(F.col("name"))).filter(F.col("trap_id").isNotNull())
    padded = F.regexp_extract(F.col("name"), r"(?i)trap_(\d+)", 1).rlike("^0|^..")
    return (
        rows.groupBy("folder", "trap_id")
        .agg(F.min_by(F.struct("path", "name"), F.struct(~padded, F.col("name"))).alias("_w"))
        .select("folder", "trap_id", "_w.*")
    )


def data_files(manifest: DataFrame) -> DataFrame:
    """Files that are not summaries or fit tables, with their number for natural order."""
    return manifest.filter(~F.lower("name").rlike("summary|fits")).withColumn("trap_id", trap_number(F.col("name")))


def images(manifest: DataFrame) -> DataFrame:
    """Distinct .tif / .tiff files in any letter case."""
    return manifest.filter(F.lower("name").rlike(r"\.tiff?$")).distinct()


def channel_frames(manifest: DataFrame, experiment: Sequence[str], channels: Mapping[str, str]) -> DataFrame:
    """Files split into channels by a substring, numbered in time order, cut to the shortest channel.

    Order is the number after '_t', else the trailing digits, else 0, then the name.
    """
    channel = None
    for name, part in channels.items():
        hit = F.col("name").contains(part)
        channel = F.when(hit, name) if channel is None else channel.when(hit, name)
    rows = (
        manifest.withColumn("channel", channel)
        .filter(F.col("channel").isNotNull())
        .withColumn("_number", F.coalesce(frame_number(F.col("name")), F.lit(0)))
    )
    keys = [*experiment, "channel"]
    numbered = number_rows(rows, keys, ["_number", "name"], "_number", n_rows="_n")
    shortest = numbered.groupBy(*experiment).agg(F.min("_n").alias("_least"))
    return (
        numbered.join(shortest, list(experiment)).filter(F.col("frame") < F.col("_least")).drop("_number", "_n", "_least")
    )


def _seconds(pattern: str, name: Column) -> Column:
    text = F.nullif(F.regexp_extract(name, TIME_PATTERNS[pattern], 1), F.lit(""))
    if pattern == "dashed":
        return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd_HH-mm-ss"))).cast("double")
    if pattern == "compact":
        return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyyMMdd_HHmmss"))).cast("double")
    return text.cast("double") / (1000.0 if pattern == "milliseconds" else 1.0)


def name_times(frames: DataFrame, experiment: Sequence[str], *, interval: float = 0.2, frame: str = "frame") -> DataFrame:
    """Adds time_s and time_source: the first pattern that every file of the experiment matches, else frame * interval.

    Date patterns count from the first frame.
    """
    found = frames
    for p in TIME_PATTERNS:
        found = found.withColumn(f"_{p}", _seconds(p, F.col("name")))
    whole = found.groupBy(*experiment).agg(
        *[(F.count(f"_{p}") == F.count(F.lit(1))).alias(f"_all_{p}") for p in TIME_PATTERNS],
        *[F.min_by(f"_{p}", frame).alias(f"_first_{p}") for p in ("dashed", "compact")],
    )
    joined = found.join(whole, list(experiment))
    time = source = None
    for p in TIME_PATTERNS:
        value = F.col(f"_{p}") - F.col(f"_first_{p}") if p in ("dashed", "compact") else F.col(f"_{p}")
        ok = F.col(f"_all_{p}")
        time = F.when(ok, value) if time is None else time.when(ok, value)
        source = F.when(ok, p) if source is None else source.when(ok, p)
    return joined.select(
        *frames.columns,
        time.otherwise(F.col(frame) * F.lit(interval)).alias("time_s"),
        source.otherwise("manual").alias("time_source"),
    )


def without_black_tail(frames: DataFrame, keys: Sequence[str], mean: str, *, threshold: float = 1.0, frame: str = "frame") -> DataFrame:
    """Drops the last frame of a channel when it is darker than the threshold."""
    last = frames.groupBy(*keys).agg(F.max(frame).alias("_last"))
    return (
        frames.join(last, list(keys))
        .filter(~((F.col(frame) == F.col("_last")) & (F.col(mean) < threshold)))
        .drop("_last")
    )
