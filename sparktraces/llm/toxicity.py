"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word is embedded as the mean of the hashed embeddings of itself and of its leading and trailing letter
groups, so that inflected and unseen forms share what is known of their stem. Convolutions of several widths run over the
words, max pooling keeps the strongest answer of each filter anywhere in the text, and a logistic unit gives
the score. All of it is trained in numpy on a bounded sample of labelled rows and applied by tasks to whole texts,
a window of words at a time, so memory does not grow with the text.

The score reads the text alone. Thresholds are calibrated by language on a fifth of all labelled rows, at their natural
shares and kept out of training; the score itself is rescaled once so that 0.3 is the best common threshold.

Defined results. A null or empty text, or one without words, has the score that empty pooling gives. Repeated
rows have equal scores. Without any training rows of either label every score is 0. A label that is null, or whose document
is missing, is not learnt from. An empty table gives no rows. Columns other than the named ones pass through `kept` untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraces.operators.stage import staged

WORDS = re.compile(r"\w+").findall
SLOTS = 1 << 14
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
PARTS = 6
#: Words that go through the filters at a time.
WINDOW = 4096
#: Words of a harmless text that a training step reads, at a random place; of a toxic text it reads more.
TRAINING_WORDS = {0: 400, 1: 3000}
#: Upper bound of the labelled rows that the filters are fitted on, half of them of each label if there are as many.
SAMPLE = 4000
EPOCHS = 6
TABLE_RATE = 0.01
#: Toxic calibration rows that a language needs for a threshold of its own.
LANGUAGE_TOXIC = 20
#: Bins of calibration logits to the unit; logits further out than FAR count as FAR.
BINS, FAR = 256, 64
#: Words whose filter answers a task keeps; when there are more it starts anew.
KEPT_WORDS = 100_000
CUTOFF = 0.3


def word_slots(word: str) -> tuple[int, ...]:
    """Table slots of a word: itself, and its first and last letters in growing groups."""
    forms = (f"={word}", f"^{word[:4]}", f"^{word[:5]}", f"^{word[:6]}", f"^{word[:7]}", f"${word[-5:]}")
    return tuple(zlib.crc32(f.encode()) % SLOTS for f in forms)


@dataclass
class Model:
    """Parameters, and the scale that maps the raw logit so that CUTOFF is the best common threshold."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    known: _Known = field(default_factory=lambda: _Known())

    def projections(self, words: list[str]) -> np.ndarray:
        """Each word's share in the answers of all filters, for every place that the word can have in them."""
        slots = np.array([word_slots(w) for w in words], np.int32).reshape(len(words), PARTS)
        stacked = np.concatenate([f[i] for f in self.filters for i in range(len(f))], axis=1)
        return self.table[slots].mean(axis=1) @ stacked

    def logit(self, text: str | None) -> float:
        """Strongest rectified answer of every filter over all words of the text, window by window, then weighed."""
        words = WORDS((text or "").lower())
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for start in range(0, len(words), WINDOW):
            shares = self.known.shares(self, words[start : start + WINDOW + max(WIDTHS) - 1])
            column = 0
            for k, width in enumerate(WIDTHS):
                n = len(shares) - width + 1
                if n > 0:
                    answers = shares[:n, column : column + FILTERS]
                    for i in range(1, width):
                        at = column + i * FILTERS
                        answers = answers + shares[i : i + n, at : at + FILTERS]
                    here = best[k * FILTERS : (k + 1) * FILTERS]
                    np.maximum(here, answers.max(axis=0) + self.biases[k], out=here)
                column += width * FILTERS
        return float(best @ self.weights + self.bias)

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(text) + self.shift, -30, 30))))


class _Known:
    """Filter answers by word, within bounds; it is not sent along with the model."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, sum(WIDTHS) * FILTERS), np.float32)

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, _: dict) -> None:
        self.__init__()

    def shares(self, model: Model, words: list[str]) -> np.ndarray:
        if len(self.index) > KEPT_WORDS:
            self.__init__()
        index = self.index
        if new := [w for w in dict.fromkeys(words) if w not in index]:
            first = len(index)
            if first + len(new) > len(self.rows):
                grown = np.zeros((2 * (first + len(new)), self.rows.shape[1]), np.float32)
                grown[:first] = self.rows[:first]
                self.rows = grown
            self.rows[first : first + len(new)] = model.projections(new)
            index.update(zip(new, range(first, first + len(new))))
        return self.rows[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]


def text_slots(text: str | None) -> np.ndarray:
    """(words, parts) table of slots of a whole text."""
    words = WORDS((text or "").lower())
    return np.array([word_slots(w) for w in words], np.int32).reshape(len(words), PARTS)


def slot_odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Where training starts: how much more often toxic texts hold a slot, drawn to 0 where few texts hold it."""
    held = np.zeros((2, SLOTS))
    for slots, label in zip(texts, labels):
        held[int(label), np.unique(slots)] += 1
    rates = (held + 0.5) / (np.array([[(labels == 0).sum()], [(labels == 1).sum()]]) + 1.0)
    return (np.log(rates[1] / rates[0]) * held[1] / (held[1] + 4.0)).astype(np.float32)


def trained(texts: list[np.ndarray], labels: np.ndarray, *, seed: int = 5) -> Model:
    """A model fitted by Adagrad on the logistic loss; the rarer label weighs more, up to eight times."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (SLOTS, SIZE)).astype(np.float32)
    filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weights = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    model = Model(table, filters, biases, weights, 0.0)
    positive = float(labels.mean()) if len(labels) else 0.0
    if positive in (0.0, 1.0):
        model.bias, model.weights = -30.0, np.zeros_like(weights)
        return model
    heavy = min(8.0, (1 - positive) / positive)
    table[:, 0] = slot_odds(texts, labels)
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :])
        f[:, 0, 0] = 1.0
    np.abs(weights, out=weights)
    grad_table = np.full_like(table, 1e-6)
    grad_weights = np.full_like(weights, 1e-6)
    grads_f, grads_b, grad_bias = [np.full_like(f, 1e-6) for f in filters], [np.full_like(b, 1e-6) for b in biases], 1e-6
    rate = 0.05
    for epoch in range(EPOCHS):
        for at in rng.permutation(len(texts)):
            slots = texts[at]
            if len(slots) > (most := TRAINING_WORDS[int(labels[at])]):
                start = int(rng.integers(0, len(slots) - most + 1))
                slots = slots[start : start + most]
            words = model.table[slots].mean(axis=1) if len(slots) else np.zeros((0, SIZE), np.float32)
            pooled, where = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, -1)
            for k, width in enumerate(WIDTHS):
                n = len(words) - width + 1
                if n > 0:
                    answers = sum(words[i : i + n] @ model.filters[k][i] for i in range(width)) + model.biases[k]
                    top = answers.argmax(axis=0)
                    value = answers[top, np.arange(FILTERS)]
                    pooled[k * FILTERS : (k + 1) * FILTERS] = np.maximum(value, 0)
                    where[k * FILTERS : (k + 1) * FILTERS] = np.where(value > 0, top, -1)
            logit = float(pooled @ model.weights + model.bias)
            error = (1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))) - labels[at]) * (heavy if labels[at] else 1.0)
            back = error * model.weights
            step = error * pooled + 1e-5 * model.weights
            grad_weights += step * step
            model.weights -= rate * step / np.sqrt(grad_weights)
            grad_bias += error * error
            model.bias -= rate * error / np.sqrt(grad_bias)
            for j in np.flatnonzero(where >= 0):
                k, c = divmod(j, FILTERS)
                width, first = WIDTHS[k], where[j]
                window = words[first : first + width]
                g = back[j] * window
                old = model.filters[k][:, :, c].copy()
                grads_f[k][:, :, c] += g * g
                model.filters[k][:, :, c] -= rate * g / np.sqrt(grads_f[k][:, :, c])
                grads_b[k][c] += back[j] ** 2
                model.biases[k][c] -= rate * back[j] / np.sqrt(grads_b[k][c])
                for i in range(width):
                    rows = slots[first + i]
                    g = back[j] * old[i] / PARTS
                    grad_table[rows] += g * g
                    model.table[rows] -= TABLE_RATE * g / np.sqrt(grad_table[rows])
    return model


def best_cut(counts: dict[int, list[int]]) -> float | None:
    """The cut with the best F1 over the (clean, toxic) counts of bins, in the middle of its gap; None if one label is missing."""
    bins = np.array(sorted(counts, reverse=True), np.int64)
    clean, toxic = np.array([counts[b] for b in bins.tolist()], np.int64).reshape(-1, 2).T
    if not clean.sum() or not toxic.sum():
        return None
    i = int((2 * np.cumsum(toxic) / (np.cumsum(clean + toxic) + toxic.sum())).argmax())
    below = bins[i + 1] + 1 if i + 1 < len(bins) else bins[i] - BINS
    return float(bins[i] + below) / 2 / BINS


def in_calibration(key: Column) -> Column:
    """Whether a labelled id is kept from training for the thresholds; a fifth of them are, by digest."""
    return F.crc32(F.concat(key.cast("string"), F.lit(":calibration"))) % 5 == 0


def calibrate(model: Model, rows: DataFrame, known: DataFrame) -> None:
    """Sets the shift and the thresholds from the counts of all rows (doc, text, lang) that are ``known`` (id, label).

    Tasks score whole texts; only ids, marks and bins are shuffled, and the driver gets counts by bin. Of an id with
    several rows the one with the least digest of its text counts.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            logits = np.array([net.logit(t.as_py()) for t in batch.column("text")], np.float64)
            bins = pa.array(np.floor(np.clip(logits, -FAR, FAR) * BINS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), batch.column("lang"), bins], ["doc", "mark", "lang", "bin"])

    marked = rows.select("doc", F.md5(F.coalesce("text", F.lit(""))).alias("mark"), F.col("lang").cast("string").alias("lang"), "text")
    kind = marked.schema["doc"].dataType.simpleString()
    once = marked.mapInArrow(run, f"doc {kind}, mark string, lang string, bin int").groupBy("doc").agg(F.min(F.struct("mark", "lang", "bin")).alias("row"))
    counts = once.join(known, F.col("doc") == F.col("id")).groupBy(F.col("row.lang").alias("lang"), F.col("row.bin").alias("bin"))
    counts = staged(counts.agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic")))
    shared.unpersist()
    common = counts.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    cut = best_cut({r["bin"]: [r["clean"], r["toxic"]] for r in common})
    if cut is None:
        return
    model.shift = float(np.log(CUTOFF / (1 - CUTOFF)) - cut)
    enough = counts.groupBy(F.col("lang").alias("l")).agg(F.sum("toxic").alias("n")).filter(F.col("n") >= LANGUAGE_TOXIC)
    by_lang: dict[str, dict[int, list[int]]] = {}
    for r in counts.join(enough, F.col("lang") == F.col("l"), "left_semi").collect():
        by_lang.setdefault(r["lang"], {})[r["bin"]] = [r["clean"], r["toxic"]]
    for lang_name in sorted(by_lang):
        if (own := best_cut(by_lang[lang_name])) is not None:
            model.thresholds[lang_name] = float(1 / (1 + np.exp(-(own + model.shift))))


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    label_col: str = "toxic",
) -> Model:
    """A model from at most ``sample`` labelled rows, of each label those with the least digest of their id.

    Rows whose crc32 of the id modulo 4 is 2 are held out from everything. A fifth of all other labelled rows is kept
    from training; all of that fifth, with the labels in their natural shares, calibrates the scale and, for each
    language with enough toxic rows among it, a threshold.
    """
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    known = known.filter(F.crc32(F.col("id").cast("string")) % 4 != 2)
    place = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    halves = [known.filter(~in_calibration(F.col("id")) & (F.col("label") == x)).orderBy(place, "id").limit(sample // 2) for x in (0, 1)]
    drawn = halves[0].unionByName(halves[1])
    key = F.col(id_col).cast(labels.schema[id_col].dataType)
    rows = docs.select(key.alias("doc"), F.col(text_col).alias("text"), lang.alias("lang"))
    found = rows.join(F.broadcast(drawn), F.col("doc") == F.col("id")).select("id", "text", "label")
    found = found.toPandas().sort_values(["id", "text"], kind="stable").drop_duplicates("id")
    truth = found["label"].to_numpy(np.float32)
    model = trained([text_slots(t) for t in found["text"]], truth)
    if len(truth) and 0 < truth.mean() < 1:
        apart = in_calibration(F.col("doc")) & (F.crc32(F.col("doc").cast("string")) % 4 != 2)
        calibrate(model, rows.filter(apart), known.filter(in_calibration(F.col("id"))))
    return model


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, score, threshold): the threshold is that of the row's language, else the common cutoff."""
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            scores = pa.array([net.score(t.as_py()) for t in batch.column("text")], pa.float64())
            cuts = pa.array([net.thresholds.get(x, CUTOFF) for x in batch.column("lang").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores, cuts], ["doc_id", "score", "threshold"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.cast("string").alias("lang"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, threshold double")


def kept(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold of their language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            langs = batch.column(lang_col).to_pylist() if lang_col else [None] * batch.num_rows
            texts = batch.column(text_col)
            clean = [net.score(t.as_py()) < net.thresholds.get(x, CUTOFF) for t, x in zip(texts, langs)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
