"""Exact top-k inner products from an impact-ordered index, read score at a time.

Integer vectors are dealt into blocks by a digest of their id. A block's index holds, for every dimension, its postings in
order of value, so the postings of one range of quantised impact are a slice. A query reads the slices of all dimensions
from the largest impact downwards into accumulators. After each level it knows an upper bound of every score: what is
read counts exactly, and a dimension not read yet gives at most the level, or its own largest impact. The vectors
with the fullest accumulators are scored exactly, and the k-th of them is the bar. A vector leaves only when
its upper bound is below the bar; when few are left, or all positive impacts are read, those are scored exactly.

Every block gives its k best, and the best of these are the result. Queries come in bounded chunks, each of which
meets each block once: a query set against all rows, in blocks.

Defined results. Vectors that are null, empty, or hold a null, a NaN or an infinity, take no part on either side, nor do
those whose length is not the commonest. Equal scores go to the smaller id. A repeated row is a candidate of its
own, but never of a query with its id; a query id in several rows is searched with its least vector. With fewer than k
candidates all are given. An empty table gives no rows. Other columns are not read. Scores must stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraces.llm.vectors import best, dealt, prepared, query_set
from sparktraces.operators.stage import staged

#: Vectors of a block and queries of a chunk, on average: they bound the memory of one task.
BLOCK, CHUNK = 4096, 2048
#: Small tables are cut into this many blocks as long as a block has a few hundred vectors.
LEAST_BLOCKS = 6
#: Range of values up to which a block keeps where each value begins; beyond it that is searched for.
TABLE = 1 << 14
#: Impact levels after which the bounds are looked at, as shares of the largest impact.
LEVELS = (0.35, 0.1, 0.0)


class ImpactIndex:
    """Postings of one block, by dimension in order of value, and where each value begins."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.docs = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(self.vectors.T, self.docs, axis=1)
        self.least = int(self.values.min())
        span = int(self.values.max()) - self.least + 1
        self.begins = None
        if span <= TABLE:
            held = np.stack([np.bincount(row - self.least, minlength=span) for row in self.values])
            self.begins = np.concatenate((np.zeros((len(held), 1), np.int64), held.cumsum(axis=1)), axis=1)

    def cut(self, dims: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each dimension the first posting whose value is at least ``at``."""
        if self.begins is None:
            return np.array([np.searchsorted(self.values[d], v) for d, v in zip(dims, at)], np.int64)
        return self.begins[dims, np.clip(at - self.least, 0, self.begins.shape[1] - 1)]

    def postings(self, dims: np.ndarray, weights: np.ndarray, low: int, high: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the postings of each dimension whose impact is at least ``low`` and, unless None, less than ``high``."""
        up = weights > 0
        edge = self.cut(dims, np.where(up, -(-low // weights), low // weights + 1))
        if high is None:
            other = np.where(up, len(self.ids), 0)
        else:
            other = self.cut(dims, np.where(up, -(-high // weights), high // weights + 1))
        return np.where(up, edge, other), np.where(up, other, edge)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of the block, without rows of the query's own id."""
        members = np.flatnonzero(self.ids != query_id)
        take, n = min(k, len(members)), len(self.ids)
        if not take:
            return self.ids[:0], np.zeros(0, np.int64)
        dims = np.flatnonzero(query)
        weights = query[dims]
        most = np.maximum(self.values[dims, 0] * weights, self.values[dims, -1] * weights)
        read, count, bar = np.zeros(n), np.zeros(n), -np.inf
        top = int(most.max()) if len(dims) else 0
        high: int | None = None
        for share in LEVELS if top > 0 else ():
            low = int(share * top)
            reached = most >= low
            starts, stops = self.postings(dims[reached], weights[reached], low, high)
            parts = list(zip(dims[reached].tolist(), weights[reached].tolist(), starts.tolist(), stops.tolist()))
            docs = [self.docs[d, a:b] for d, _, a, b in parts if a < b]
            if docs:
                at = np.concatenate(docs)
                read += np.bincount(at, np.concatenate([self.values[d, a:b] * w for d, w, a, b in parts if a < b]), n)
                count += np.bincount(at, minlength=n)
            high = low
            # a dimension that was read has its largest impact at or above the level, so the level was its cap
            upper = read + np.minimum(most, low).sum() - low * count
            ahead = members if len(members) <= 4 * take else members[np.argpartition(-read[members], 4 * take)[: 4 * take]]
            exact = self.vectors[ahead] @ query
            bar = max(bar, np.partition(exact, len(exact) - take)[len(exact) - take])
            members = members[upper[members] >= bar]
            if len(members) <= 8 * take:
                break
        scores = self.vectors[members] @ query
        order = np.lexsort((self.ids[members], -scores))[:take]
        return self.ids[members[order]], scores[order]


def impact_topk(rows: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows.

    Components x become floor(scale * x); the score is the integer inner product.
    """
    vectors, _ = prepared(rows, id_col, vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    queries = staged(query_set(vectors, every))
    rows_in = vectors.count()
    blocks = max(1, rows_in // BLOCK, min(LEAST_BLOCKS, rows_in // 512))
    chunks = max(1, queries.count() // CHUNK)
    indexed = vectors.withColumn("block", dealt("block", "vec_id", blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = queries.withColumn("chunk", dealt("chunk", "query_id", chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        if len(block) and len(chunk):
            index = ImpactIndex(block["vec_id"].to_numpy(), np.stack(block["vector"].to_list()).astype(np.int64))
            for query_id, query in zip(chunk["query_id"], chunk["query"]):
                ids, scores = index.top(query_id, np.asarray(query, np.int64), k)
                found.append((np.full(len(ids), query_id), ids, scores))
        columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ()))]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    parts = indexed.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(search, "query_id long, vec_id long, score long")
    return best(parts, k, largest=True)
