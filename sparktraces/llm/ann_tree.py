"""Approximate nearest neighbours through a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and every row is filed under a leaf. A query takes the open node with the nearest centre
from a priority queue, opens it, and goes on until it has visited enough leaves. How many are enough is calibrated: queries
of the sample, whose neighbours in the sample are known by brute force, are widened until the wanted recall is reached.
A query also goes on until its leaves hold k candidates, so none gets less than there is.

A leaf with many rows is filed in parts of bounded size, and queries come in bounded chunks, so a leaf that holds a third
of all rows is searched by many tasks. Distances are exact, on the original vectors in double precision.

Defined results. Vectors that are null, empty, all zero, or hold a null, a NaN or an infinity, take no part on either side, nor do
those whose length is not the commonest. Equal distances go to the smaller id. A repeated row is a candidate of its own,
but never of a query with its id; a query id in several rows is searched with its least vector. With fewer than k candidates all
are given. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraces.llm.vectors import best, dealt, prepared, query_set
from sparktraces.operators.stage import lookup_side, staged

#: Upper bound of the vectors that the tree is fitted on.
SAMPLE = 12_000
BRANCHES, LEAF = 8, 96
ROUNDS = 6
#: Calibration queries, and the recall on them until which visits are widened.
TRIALS, RECALL = 200, 0.97
#: Vectors of a part of a leaf and queries of a chunk, on average: they bound the memory of one task.
PART, CHUNK = 2048, 2048


@dataclass
class Tree:
    """Centres of all nodes, their children, and the leaf numbers of nodes without children."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        out = np.zeros(len(vectors), np.int64)
        work = [(0, np.arange(len(vectors)))]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = _squares(vectors[rows], self.centres[kids]).argmin(axis=1)
            work += [(int(kid), rows[near == i]) for i, kid in enumerate(kids)]
        return out

    def bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in order of a best-bin-first traversal."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
                continue
            kids = self.children[node]
            for distance, kid in zip(((self.centres[kids] - query) ** 2).sum(axis=1).tolist(), kids.tolist()):
                heapq.heappush(queue, (distance, kid))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]


def grown(sample: np.ndarray, *, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 3) -> Tree:
    """A tree over the sample; a node that its vectors do not split is a leaf, whatever its size."""
    rng = np.random.default_rng(seed)
    centres, children, leaves = [sample.mean(axis=0)], [np.zeros(0, np.int64)], [-1]
    work, numbered = [(0, np.arange(len(sample)))], 0
    while work:
        node, rows = work.pop()
        groups: list[np.ndarray] = []
        if len(rows) > leaf:
            points = sample[rows]
            middle = points[rng.choice(len(points), branches, replace=False)]
            for _ in range(ROUNDS):
                near = _squares(points, middle).argmin(axis=1)
                middle = np.stack([points[near == i].mean(axis=0) if (near == i).any() else middle[i] for i in range(branches)])
            near = _squares(points, middle).argmin(axis=1)
            groups = [np.flatnonzero(near == i) for i in range(branches)]
            groups = [g for g in groups if len(g)]
        if len(groups) < 2:
            leaves[node], numbered = numbered, numbered + 1
            continue
        first = len(centres)
        children[node] = np.arange(first, first + len(groups))
        for i, g in enumerate(groups):
            centres.append(points[g].mean(axis=0))
            children.append(np.zeros(0, np.int64))
            leaves.append(-1)
            work.append((first + i, rows[g]))
    return Tree(np.stack(centres), children, np.array(leaves))


def calibrated(tree: Tree, sample: np.ndarray, k: int, *, trials: int = TRIALS, recall: float = RECALL) -> int:
    """Leaves to visit so that the trials find the wanted share of their true neighbours in the sample."""
    filed = tree.file(sample)
    at = np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int)
    hits = np.zeros(tree.leaves + 1)
    wanted = 0
    for i in np.unique(at):
        distances = ((sample - sample[i]) ** 2).sum(axis=1)
        distances[i] = np.inf
        true = np.argsort(distances, kind="stable")[: min(k, len(sample) - 1)]
        rank = {b: r for r, b in enumerate(tree.bins(sample[i]), 1)}
        for t in true:
            hits[rank[int(filed[t])]] += 1
        wanted += len(true)
    enough = np.flatnonzero(np.cumsum(hits) >= recall * wanted)
    return max(1, int(enough[0])) if len(enough) else tree.leaves


def nearest(
    rows: DataFrame, *, k: int = 10, every: int = 100, sample: int = SAMPLE, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k nearest found others."""
    spark = rows.sparkSession
    nonzero = F.exists(F.col(vector_col), lambda x: x != 0)
    vectors, width = prepared(rows, id_col, vector_col, lambda x: x.cast("double"), nonzero)
    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id", "vector").limit(sample).select("vector").toPandas()
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = np.stack(drawn["vector"].to_list()).astype(np.float64)
    tree = grown(points)
    visits = calibrated(tree, points, k, recall=recall)
    shared = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(shared.value.file(flat))], ["vec_id", "vector", "leaf"])

    filed = staged(vectors.mapInArrow(file, "vec_id long, vector array<double>, leaf long"))
    sizes = filed.groupBy("leaf").agg(F.count("*").alias("size"))
    # one number for each leaf of the tree, whose size the sample bounds
    counts = np.zeros(tree.leaves, np.int64)
    for row in sizes.collect():
        counts[row["leaf"]] = row["size"]
    parts = np.maximum(1, counts // PART)
    queries = staged(query_set(filed, every))
    chunks = max(1, queries.count() // CHUNK)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            flat = batch.column("query").flatten().to_numpy().reshape(batch.num_rows, width)
            for i in range(batch.num_rows):
                seen, held = 0, 0
                for leaf in shared.value.bins(flat[i]):
                    # the query's own row does not count as a candidate
                    if seen >= visits and held > k:
                        break
                    found += [(i, leaf, p) for p in range(parts[leaf])] if counts[leaf] else []
                    seen, held = seen + 1, held + int(counts[leaf])
            at, leaf, part = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), batch.column("query").take(pa.array(at)), pa.array(leaf), pa.array(part)], ["query_id", "query", "leaf", "part"])

    asked = queries.mapInArrow(route, "query_id long, query array<double>, leaf long, part long").withColumn("chunk", dealt("chunk", "query_id", chunks))
    split = lookup_side(sizes.select(F.col("leaf").alias("of"), F.greatest(F.lit(1), F.floor(F.col("size") / PART)).alias("parts")))
    stored = filed.join(split, F.col("leaf") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")))
    stored = stored.select("vec_id", "vector", "leaf", "part").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def search(part: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(part) and len(chunk):
            ids, points = part["vec_id"].to_numpy(), np.stack(part["vector"].to_list())
            for query_id, query in zip(chunk["query_id"], chunk["query"]):
                scores = np.sqrt(((points - query) ** 2).sum(axis=1))
                scores[ids == query_id] = np.inf
                order = np.lexsort((ids, scores))[:k]
                order = order[ids[order] != query_id]
                out["query_id"].append(np.full(len(order), query_id))
                out["vec_id"].append(ids[order])
                out["score"].append(scores[order])
        return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in out.items()})

    keys = ["leaf", "part", "chunk"]
    found = stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    return best(found, k, largest=False)
