"""Whitening of embeddings: exact sums in tasks, spectral divide and conquer of the covariance, broadcast projection.

1. Each entry c becomes the whole number x = floor(1024 c) + 100000. Tasks add the x of every dimension exactly.
2. With m the mean rounded to whole numbers, tasks add the products of x - m, exactly as well: in double precision while every
   partial sum stays a whole number below 2**53, in Python's integers beyond. So the covariance is centred before
   multiplying and does not depend on how the rows are dealt. The shuffle carries one row for each pair of dimensions and task.
3. The driver gets width * (width + 1) / 2 numbers, whatever the table holds, and takes the components from `spectral.eigen`.
4. The projection, width times the wanted components, is broadcast, and tasks whiten every row.
5. The covariance of what came out is measured over all rows and its distance from the identity reported.

Defined results. Rows whose vector is null, empty, or holds a null, a NaN or an infinity are dropped, and so are those whose length
is not the commonest. Rows with a null id stay, and repeated rows count each time. |1024 c| beyond 2**62 counts as 2**62.
A component without variance (eigenvalue within rounding of 0) has a null ``whitened``, and ``identity_error`` does not look at it; it
is null where no component has variance, and so is ``explained`` where the trace is 0. ``deviation`` is null where it does not
fit a long. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraces.llm.spectral import eigen
from sparktraces.llm.vectors import usable, width_of
from sparktraces.operators.stage import staged

SCALE, OFFSET = 1024, 100_000
#: Largest whole number that is read from an entry.
WIDEST = 1 << 62
WORD = 1 << 64
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Rows that a task turns into a matrix at a time.
ROWS_PER_BATCH = 4096


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of Arrow batches and their vectors as rows of a matrix of whole numbers."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_PER_BATCH):
            part = batch.slice(start, ROWS_PER_BATCH)
            yield part, part.column("x").flatten().to_numpy().reshape(part.num_rows, width)


def _words(value: int) -> tuple[int, int]:
    return value >> 64, value & (WORD - 1)


def _totals(parts: DataFrame, *keys: str) -> list[tuple[tuple[int, ...], int]]:
    """Exact sums by key of numbers given as (high, low) words."""
    summed = parts.groupBy(*keys).agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return [(tuple(row[k] for k in keys), int(row["high"]) * WORD + int(row["low"])) for row in summed.collect()]


def column_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """(n, S): the number of rows and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for _, x in _matrices(batches, width):
            n += len(x)
            # halves of 32 bits cannot overflow within a batch
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + l for t, h, l in zip(total, high, low)]
        if n:
            yield _sum_rows({"i": list(range(-1, width))}, [n, *total])

    found = dict(_totals(vectors.select("x").mapInArrow(run, "i int, high decimal(38,0), low decimal(38,0)"), "i"))
    return found.get((-1,), 0), [found.get((i,), 0) for i in range(width)]


def _sum_rows(keys: dict[str, list[int]], values: list[int]) -> pa.RecordBatch:
    high, low = zip(*map(_words, values))
    wide = pa.decimal128(38, 0)
    columns = [pa.array(k, pa.int32()) for k in keys.values()] + [pa.array([int(v) for v in words], wide) for words in (high, low)]
    return pa.RecordBatch.from_arrays(columns, [*keys, "high", "low"])


def _gram(d: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``total`` (Python integers) plus the products of the columns of ``d``, exactly."""
    most = max(int(d.max()), -int(d.min()), 1)
    rows = (1 << 53) // (most * most)
    if rows >= 64:
        for start in range(0, len(d), rows):
            part = d[start : start + rows].astype(np.float64)
            total = total + (part.T @ part).astype(np.int64).astype(object)
        return total
    wide = d.astype(object)
    return total + wide.T @ wide


def covariance(vectors: DataFrame, width: int, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """(V, m): the covariance with divisor n, and the rounded means that it was centred with."""
    middle = [(2 * s + n) // (2 * n) for s in sums]
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width), object), False
        for _, x in _matrices(batches, width):
            total, seen = _gram(x - np.array(middle, np.int64), total), True
        if seen:
            yield _sum_rows({"i": upper[0].tolist(), "j": upper[1].tolist()}, total[upper].tolist())

    parts = vectors.select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    rest = [s - n * m for s, m in zip(sums, middle)]
    v = np.zeros((width, width))
    for (i, j), product in _totals(parts, "i", "j"):
        # one division of whole numbers, so each entry is right to the last digit
        v[i, j] = v[j, i] = (n * product - rest[i] * rest[j]) / (n * n)
    return v, middle


def whitened(rows: DataFrame, *, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and each of the first ``components`` principal components."""
    spark = rows.sparkSession

    def whole(c):
        bounded = F.greatest(F.lit(-float(WIDEST)), F.least(F.lit(float(WIDEST)), F.lit(float(SCALE)) * c.cast("double")))
        return F.floor(bounded).cast("long") + F.lit(OFFSET).cast("long")

    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector")))
    kept = staged(kept.select("vec_id", F.transform("vector", whole).alias("x")))
    width = width_of(kept.withColumnRenamed("x", "vector"))
    vectors = kept.filter(F.size("x") == width)
    n, sums = column_sums(vectors, width) if width else (0, [])
    if not n:
        return spark.createDataFrame([], SCHEMA)
    v, middle = covariance(vectors, width, n, sums)
    values, basis = eigen(v)
    trace = float(np.trace(v))
    taken = min(components, width)
    varied = values[:taken] > width * np.finfo(float).eps * max(trace, 0.0)
    # columns of the projection; a component without variance stays out of it
    scale = np.where(varied, 1.0 / np.sqrt(np.where(varied, values[:taken], 1.0)), 0.0)
    offset = np.array([(s - n * m) / n for s, m in zip(sums, middle)])
    shared = spark.sparkContext.broadcast((basis[:, :taken] * scale, np.array(middle, np.int64), offset, sums))

    def projected(x: np.ndarray) -> np.ndarray:
        projection, middle, offset, _ = shared.value
        return ((x - middle).astype(np.float64) - offset) @ projection

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((taken + 1, taken + 1))
        for _, x in _matrices(batches, width):
            w = np.hstack((projected(x), np.ones((len(x), 1))))
            total += w.T @ w
        i, j = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    found = np.zeros((taken + 1, taken + 1))
    for row in vectors.select("x").mapInArrow(measure, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        found[row["i"], row["j"]] = row["v"]
    mean = found[-1, :-1] / n
    apart = np.abs(found[:-1, :-1] / n - np.outer(mean, mean) - np.eye(taken))[np.ix_(varied, varied)]
    identity_error = float(apart.max()) if apart.size else None
    explained = [float(e) / trace if trace > 0 else None for e in values[:taken]]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, middle, _, sums = shared.value
        rest = [s - n * m for s, m in zip(sums, middle.tolist())]
        for batch, x in _matrices(batches, width):
            k = len(x)
            w = projected(x)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(k), taken))),
                pa.array(np.tile(np.arange(1, taken + 1, dtype=np.int32), k)),
                pa.array(np.full(k * taken, n, np.int64)),
                pa.array([d for d in _deviations(x - middle, n, rest) for _ in range(taken)], pa.int64()),
                pa.array(w.ravel(), mask=np.tile(~varied, k)),
                pa.array(explained * k, pa.float64()),
                pa.array([identity_error] * (k * taken), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return vectors.mapInArrow(whiten, SCHEMA)


def _deviations(d: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n d - rest)**2 for each row; None beyond a long."""
    most = n * max(int(d.max()), -int(d.min()), 1) + max(map(abs, rest))
    if most * most * d.shape[1] < 1 << 63:
        apart = n * d - np.array(rest, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    wide = n * d.astype(object) - np.array(rest, object)
    return [int(s) if s < 1 << 63 else None for s in (wide * wide).sum(axis=1)]
