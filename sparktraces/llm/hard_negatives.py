"""Hard negatives for anchors, mined by threshold joins on an inverted index with suffix-norm bounds.

The best partners of a query are found by a join "inner product at least t" whose threshold t falls until the query's windows are
full. Rows are dealt into blocks. A block keeps its dimensions in groups, those with most energy first, and for
every row the norm of what follows each group. At a threshold t a query of norm q cannot reach t on dimensions whose norm is
below t / q, so the inverted lists of that level leave out a row's dimensions from there on; rows that are too short are in no list.
A query adds up partial scores list by list, and a row is left alone as soon as its partial score and the product of the remaining
norms, the row's and the query's, stay below t. Rows that are left are scored exactly. If the windows are not full, the
threshold falls to the next level, where the sums go on from where they stopped.

The joins run twice: anchors against the rows of their own label, which are blocks of that label, for the positives; then against the rows
of other labels, with one window of scores for each positive. Before the second one, each anchor is searched in one block: the last
score of a full window there is a bar that no better row of any block falls below, and the windows are narrowed to it.

Defined results. Rows with a null id or label, or a null or empty vector, or one holding a null, a NaN or an infinity, take no part; nor do
those whose length is not the commonest. A repeated row counts as often as it occurs, but no row is a partner of an anchor
with its own id. An anchor id in several rows is searched with its least (vector, label). Equal scores go to the smaller id. An
anchor without positives, or a window without negatives, gives no rows, and neither does an empty table. Other columns are not
read. Scores must stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraces.llm.vectors import usable, width_of
from sparktraces.operators.stage import lookup_side, staged

#: Vectors of a block and queries of a chunk, on average: they bound the memory of one task.
BLOCK, CHUNK = 8192, 4096
#: A table too small for that is cut into this many blocks as long as a block has some hundred vectors.
LEAST_BLOCKS, LEAST_ROWS = 6, 512
#: Dimensions of a group, whose sums a list adds at once.
GROUP = 8
#: Each level of the threshold as a share of the level before.
FALL = 0.8
#: The first threshold as a share of the largest that the norms allow, and levels before every row is scored.
FIRST, LEVELS = 0.9, 12
NO_LIMIT = 1 << 62


class SuffixIndex:
    """Inverted lists of one block, which a falling threshold extends."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.copies = ids[order], labels[order], copies[order]
        vectors = vectors[order].astype(np.float64)
        self.dims = np.argsort(-(vectors * vectors).sum(axis=0), kind="stable")
        self.vectors = vectors[:, self.dims]
        self.starts = np.arange(0, vectors.shape[1], GROUP)
        self.parts = [np.ascontiguousarray(self.vectors[:, s : s + GROUP]) for s in self.starts]
        self.suffix = self._suffix(self.vectors)
        self.longest = float(self.suffix[:, 0].max())
        #: For each level the lists of every group of dimensions: rows for which the group is not covered.
        self.levels: list[tuple[float, list[np.ndarray]]] = []

    def _suffix(self, vectors: np.ndarray) -> np.ndarray:
        squares = np.add.reduceat(vectors * vectors, self.starts, axis=1)
        ends = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-12)
        return np.hstack((ends, np.zeros((len(vectors), 1))))

    def level(self, i: int) -> tuple[float, list[np.ndarray]]:
        """(norm below which a suffix is covered, the lists) of the i-th level; the last one covers nothing."""
        while len(self.levels) <= i:
            at = len(self.levels)
            norm = self.longest * FIRST * FALL**at if at < LEVELS else -1.0
            self.levels.append((norm, [np.flatnonzero(self.suffix[:, g] >= norm) for g in range(len(self.starts))]))
        return self.levels[i]

    def search(self, query_id: int, query: np.ndarray, eligible: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the rows of the k best scores inside, and the scores."""
        query = query[self.dims].astype(np.float64)
        ahead = self._suffix(query[None, :])[0]
        norm = float(ahead[0])
        least, highest = min(low for low, _ in windows), max(high for _, high in windows)
        read = np.zeros(len(self.ids))
        done = np.zeros(len(self.ids), np.int64)
        open_ = eligible & (self.ids != query_id)
        known, scores = np.zeros(0, np.int64), np.zeros(0)
        for i in range(LEVELS + 1):
            covered, lists = self.level(i)
            last = i == LEVELS or covered * norm <= least
            at = float(least) if last else covered * norm
            # a threshold above all windows finds nothing that is wanted
            if not last and at > highest:
                continue
            for g, postings in enumerate(lists):
                rows = postings[open_[postings] & (done[postings] == g)]
                rows = rows[read[rows] + ahead[g] * self.suffix[rows, g] >= at - 0.5]
                read[rows] += self.parts[g][rows] @ query[self.starts[g] : self.starts[g] + GROUP]
                done[rows] = g + 1
            bound = read + ahead[done] * self.suffix[np.arange(len(read)), done]
            found = np.flatnonzero(open_ & (bound >= at - 0.5))
            known = np.concatenate((known, found))
            scores = np.concatenate((scores, self.vectors[found] @ query))
            open_[found] = False
            if last or all(self.copies[known[(scores >= max(low, at)) & (scores <= high)]].sum() >= k for low, high in windows):
                break
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            inside = inside[np.lexsort((self.ids[known[inside]], -scores[inside]))][:k]
            out.append((known[inside], scores[inside].astype(np.int64)))
        return out


def _index(block: pd.DataFrame) -> SuffixIndex:
    return SuffixIndex(block["vec_id"].to_numpy(), block["label"].to_numpy(), block["copies"].to_numpy(), np.stack(block["vector"].to_list()))


def _searcher(k: int, same: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Joins a block of rows with a chunk of queries: (query_id, w, vec_id, score, copies) of the k best in each window."""

    def search(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(block) and len(chunk):
            index = _index(block)
            masks = {label: (index.labels == label) == same for label in chunk["label"].unique()}
            for row in chunk.itertuples(index=False):
                bounds = list(zip(row.low.tolist(), row.high.tolist()))
                for w, (rows, scores) in zip(row.w.tolist(), index.search(row.query_id, row.query, masks[row.label].copy(), bounds, k)):
                    n = len(rows)
                    out.append((np.full(n, row.query_id), np.full(n, w), index.ids[rows], scores, index.copies[rows]))
        names = ("query_id", "w", "vec_id", "score", "copies")
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * len(names)
        return pd.DataFrame(dict(zip(names, columns))).astype("int64")

    return search


FOUND = "query_id long, w long, vec_id long, score long, copies long"


def _parts(rows: Column) -> Column:
    """Into how many blocks so many rows are cut."""
    small = F.least(F.lit(LEAST_BLOCKS), F.floor(rows / LEAST_ROWS))
    return F.greatest(F.lit(1), F.floor(rows / BLOCK), small).cast("int")


def _part(parts: Column, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of, F.lit("part")), parts).cast("int")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, w, rank, vec_id, score): the k best rows of each window over all blocks, copies written out."""
    spread = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id", "w").orderBy(F.desc("score"), "vec_id")
    ranked = spread.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "w", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _joined(rows: DataFrame, asks: DataFrame, k: int, *, same: bool) -> DataFrame:
    """The k best rows of every window of the asks (query_id, label, query, w, low, high), over all blocks.

    With ``same`` a query meets the blocks of its label, else all blocks, of which it takes the rows of other labels.
    """
    if same:
        sizes = rows.groupBy("label").agg(_parts(F.count("*")).alias("blocks"))
        waiting = asks.groupBy("label").agg(F.greatest(F.lit(1), F.floor(F.count("*") / CHUNK)).cast("int").alias("chunks"))
        shape = lookup_side(sizes.join(waiting, "label"))
        rows, asks, place = rows.join(shape, "label"), asks.join(shape, "label"), ["label", "block", "chunk"]
    else:
        blocks, chunks = _parts(F.lit(rows.count())), F.lit(max(1, asks.count() // CHUNK))
        rows, asks = (t.withColumn("blocks", blocks).withColumn("chunks", chunks) for t in (rows, asks))
        place = ["block", "chunk"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = rows.withColumn("block", _part(F.col("blocks"), "vec_id", "vector")).withColumn("chunk", every("chunks")).drop("blocks", "chunks")
    asked = asks.withColumn("chunk", _part(F.col("chunks"), "query_id")).withColumn("block", every("blocks")).drop("blocks", "chunks")
    return _best(stored.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(_searcher(k, same), FOUND), k)


def _narrowed(rows: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """The asks with each window cut below the k-th score that one block, drawn by the query's id, has inside it."""
    blocks = _parts(F.lit(rows.count()))
    stored = rows.withColumn("block", _part(blocks, "vec_id", "vector"))
    asked = asks.withColumn("block", _part(blocks, "query_id"))
    found = stored.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(_searcher(k, False), FOUND)
    bars = _best(found, k).filter(F.col("rank") == k).groupBy(F.col("query_id").alias("q"))
    bars = bars.agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("bars"))
    raised = F.zip_with("w", "low", lambda w, low: F.greatest(low, F.coalesce(F.try_element_at("bars", w), low)))
    return asks.join(bars, F.col("query_id") == F.col("q"), "left").select("query_id", "label", "query", "w", raised.alias("low"), "high")


def hard_negatives(
    rows: DataFrame,
    *,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components x become floor(scale * x). Anchors are the rows whose id is divisible by ``every``; a negative of a positive scores
    between ``low_percent`` and ``high_percent`` of the positive's score.
    """
    packed = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    packed = packed.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    vectors = staged(packed.withColumn("vector", whole).groupBy("vec_id", "label", "vector").agg(F.count("*").alias("copies")))
    vectors = vectors.filter(F.size("vector") == width_of(vectors))
    anchors = vectors.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"))
    anchors = anchors.agg(F.min(F.struct("vector", "label")).alias("a")).select("query_id", F.col("a.label").alias("label"), F.col("a.vector").alias("query"))
    anchors = staged(anchors)
    no_limit = {c: F.array(F.lit(v).cast("long")) for c, v in (("w", 0), ("low", -NO_LIMIT), ("high", NO_LIMIT))}
    found = staged(_joined(vectors, anchors.withColumns(no_limit), positives, same=True))

    # low p <= 100 s <= high p in whole numbers; a negative p leaves no score between
    exact = F.col("score").cast("decimal(38,0)")
    window = F.struct(
        F.col("rank").cast("long").alias("w"),
        F.ceil(exact * low_percent / 100).cast("long").alias("low"),
        F.floor(exact * high_percent / 100).cast("long").alias("high"),
    )
    windows = found.filter("score >= 0").groupBy(F.col("query_id").alias("q")).agg(F.sort_array(F.collect_list(window)).alias("windows"))
    asks = anchors.join(windows, F.col("query_id") == F.col("q")).select("query_id", "label", "query", "windows.w", "windows.low", "windows.high")
    asks = staged(asks)
    asks = staged(_narrowed(vectors, asks, negatives))
    near = _joined(vectors, asks, negatives, same=False)
    near = near.select("query_id", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = found.select(
        F.col("query_id").alias("anchor_id"), F.col("rank").cast("long").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    both = of.join(near, (F.col("anchor_id") == F.col("query_id")) & (F.col("p") == F.col("w")))
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
