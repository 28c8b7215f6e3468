"""Incremental versions of the alarms and of the windowed summaries.

Rows may come in any order within the lateness that the watermark allows. A stream over a source that has an end is closed with
`closing`: a mark behind the last row moves the watermark past everything, so the last rows and windows come out, too.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sparktraces.operators.events import IQR_TO_SIGMA, Settings
from sparktraces.operators.stage import staging_path

#: Buckets of traces that share a state. Each is read and written as a whole.
BUCKETS = 64
#: What is kept of the traces of a bucket whose rows are done with: rows seen, last baseline values, drift sum, alarms already
#: raised, time of the last row in microseconds; and the rows that wait for the watermark: trace, time, value.
STATE = (
    "name ARRAY<{key}>, seen ARRAY<LONG>, recent ARRAY<ARRAY<DOUBLE>>, total ARRAY<DOUBLE>, fired ARRAY<ARRAY<STRING>>, last ARRAY<LONG>, "
    "owner ARRAY<{key}>, t ARRAY<LONG>, y ARRAY<DOUBLE>"
)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time of the row that closes a stream, which Arrow and pandas can hold; rows must be a century older.
END = dt.datetime(2250, 1, 1)
CENTURY = dt.timedelta(days=36_500)


def advance(state: tuple, values: np.ndarray, s: Settings) -> tuple[tuple, list[tuple[int, str]]]:
    """Feeds values to the spike and drift alarms; returns the new state and (frame, kind) of new alarms.

    The state is (rows seen, last baseline values, drift sum, alarms already raised):
    a fixed handful of numbers per trace, whatever its length.
    """
    seen, recent, total, fired = state
    keep = s.baseline + s.lag
    line = np.concatenate((np.asarray(recent, float), np.asarray(values, float)))
    frames = seen + np.arange(len(values))
    warm = frames >= s.warm_up
    out: list[tuple[int, str]] = []
    if warm.any():
        # the baseline of a row ends ``lag`` rows before it
        at = len(recent) + np.flatnonzero(warm) - keep
        base = np.lib.stride_tricks.sliding_window_view(line, s.baseline)[at]
        q25, mu, q75 = np.percentile(base, [25, 50, 75], axis=1)
        sigma = np.maximum(np.minimum((q75 - q25) * IQR_TO_SIGMA, s.max_sigma), s.noise_floor)
        rise = line[len(recent):][warm] - mu
        dev = rise - np.maximum(s.min_drift, s.drift_factor * sigma)
        # a sum that starts again after every row without drift
        up = np.where(dev > 0, dev, 0.0)
        run = np.cumsum(dev <= 0)
        sums = np.cumsum(up)
        started = np.concatenate(([0.0], sums))[np.searchsorted(run, run, "left")]
        drift = sums - started + np.where(run == 0, total, 0.0)
        total = float(drift[-1])
        found = {"spike": rise > s.spike_sigma * sigma, "drift": drift > np.maximum(s.min_sum, s.sum_factor * sigma)}
        out = [(int(frames[warm][hit.argmax()]), kind) for kind, hit in found.items() if kind not in fired and hit.any()]
    return (seen + len(values), line[-keep:].tolist(), total, [*fired, *(kind for _, kind in out)]), sorted(out)


def _alarms_of(key: str, settings: Settings, idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Holds the rows of a bucket of traces until the watermark has passed them, then feeds each trace to the alarms in time order.

    The state of a bucket comes and goes in one piece with its rows, so a batch costs no calls per trace. A trace without rows for
    ``idle_ms`` is forgotten, if that is given.
    """

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if bucket[0] < 0:
            # rows without a key, such as the closing mark
            return
        *alarms, owner, t, y = state.get if state.exists else ([],) * 9
        traces = {k: a for k, *a in zip(*alarms)}
        owner = list(owner) + [k for b in parts for k in b[key].tolist()]
        t = np.concatenate([np.array(t, np.int64), *(b["at_us"].to_numpy(np.int64) for b in parts)])
        y = np.concatenate([np.array(y, float), *(b["value_y"].to_numpy(float) for b in parts)])
        now = state.getCurrentWatermarkMs()
        code, names = pd.factorize(pd.Series(owner, dtype=object))
        ready = np.flatnonzero(t < now * 1000)
        ready = ready[np.lexsort((y[ready], t[ready], code[ready]))]
        found: list[tuple[object, int, str]] = []
        for rows in np.split(ready, np.flatnonzero(np.diff(code[ready])) + 1) if len(ready) else []:
            name = names[code[rows[0]]]
            alarm, new = advance(tuple(traces.get(name, (0, [], 0.0, []))[:4]), y[rows], settings)
            traces[name] = [*alarm, int(t[rows[-1]])]
            found += [(name, f, kind) for f, kind in new]
        left = np.flatnonzero(t >= now * 1000)
        due = [int(t[left].min()) // 1000 + 1] if len(left) else []
        if idle_ms is not None:
            waiting = {owner[i] for i in left}
            traces = {k: a for k, a in traces.items() if k in waiting or a[4] // 1000 + idle_ms >= now}
            due += [a[4] // 1000 + idle_ms + 1 for k, a in traces.items() if k not in waiting]
        if traces or len(left):
            columns = [list(c) for c in zip(*([k, *a] for k, a in traces.items()))] or [[]] * 6
            state.update((*columns, [owner[i] for i in left], t[left].tolist(), y[left].tolist()))
            if due:
                state.setTimeoutTimestamp(max(min(due), now + 1))
        else:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=[key, "at_frame", "kind"])

    return step


def online_alarms(
    stream: DataFrame, key: str, t: str, y: str, *, settings: Settings = Settings(), late: str = "10 minutes", idle_ms: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """First spike and drift alarm per trace of a stream: (key, at_frame, kind).

    Rows that are no later than ``late`` count in the order of their event times, however the batches cut them; later ones are
    left out. Rows without a key or value are left out. Traces shorter than the warm-up raise nothing.
    """
    key_type = stream.schema[key].dataType.simpleString()
    # rows without a key, of which the closing mark is one, have a bucket of their own
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int").alias("bucket")
    rows = stream.select(bucket, key, F.col(t).alias("at_t"), F.unix_micros(t).alias("at_us"), F.col(y).cast("double").alias("value_y"))
    marked = rows.withWatermark("at_t", late).filter(F.col("value_y").isNotNull() | F.col(key).isNull())
    return marked.groupBy("bucket").applyInPandasWithState(
        _alarms_of(key, settings, idle_ms), f"{key} {key_type}, at_frame LONG, kind STRING", STATE.format(key=key_type), "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def file_stream(spark: SparkSession, path: str, schema: StructType, *, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files; ``path`` is a folder of files or one file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def replayed(rows: DataFrame, arrival: Column, batches: int) -> DataFrame:
    """The rows as a stream of ``batches`` micro-batches in the order of ``arrival``.

    Each batch is one file; the files get modification times in the order of their numbers, which the file source goes by.
    """
    spark = rows.sparkSession
    path = staging_path(spark, "replay")
    rows.withColumn("_arrival", arrival).repartitionByRange(batches, "_arrival").drop("_arrival").write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for i, name in enumerate(names):
        system.setTimes(spark._jvm.org.apache.hadoop.fs.Path(folder, name), 1_600_000_000_000 + 60_000 * i, -1)
    return file_stream(spark, path, rows.schema, files_per_batch=1)


def closing(stream: DataFrame, t: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream and, once the second result is called, a last row: all NULL but for an event time behind all others."""
    spark = stream.sparkSession
    path = staging_path(spark, "end")
    columns = [F.lit(END).cast(f.dataType).alias(f.name) if f.name == t else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    mark = spark.range(1).select(*columns)
    mark.limit(0).coalesce(1).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path)), lambda: mark.write.mode("append").parquet(path)


def before_end(windows: DataFrame) -> DataFrame:
    """Window results without the window of the closing mark."""
    return windows.filter(F.col("window.start") < F.lit(END - CENTURY))


def window_summary(
    stream: DataFrame, groups: Sequence[str], t: str, y: str, *, length: str, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Count, mean and maximum per tumbling (or sliding) window and group; late rows past the watermark are left out."""
    window = F.window(t, length, slide) if slide else F.window(t, length)
    return _summary(stream.withWatermark(t, late), window, groups, y)


def session_summary(stream: DataFrame, groups: Sequence[str], t: str, y: str, *, gap: str, late: str = "10 minutes") -> DataFrame:
    """The same per session: runs of rows less than ``gap`` apart. A row that comes late joins the sessions on both sides of it."""
    return _summary(stream.withWatermark(t, late), F.session_window(t, gap), groups, y)


def _summary(stream: DataFrame, window: Column, groups: Sequence[str], y: str) -> DataFrame:
    return stream.groupBy(window.alias("window"), *groups).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.max(y).alias("peak"))


@contextmanager
def _state_store(spark: SparkSession):
    """A state store on disk, in as many parts as there are cores at most, for the queries that start inside.

    Every batch opens and commits every part, however little it holds.
    """
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(max(1, parts))}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def drain(result: DataFrame, name: str, *, close: Callable[[], None] | None = None) -> DataFrame:
    """Runs a stream over what its source holds now and returns the finalised rows; ``close`` is that of `closing`."""
    spark = result.sparkSession
    root = staging_path(spark, name)

    def run() -> None:
        started = (
            result.writeStream.format("parquet")
            .option("path", f"{root}/rows")
            .option("checkpointLocation", f"{root}/progress")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        started.awaitTermination()

    with _state_store(spark):
        run()
        if close is not None:
            close()
            run()
    return spark.read.schema(result.schema).parquet(f"{root}/rows")
