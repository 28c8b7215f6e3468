"""Token counts of whole texts under a sentencepiece model, by batch encoding that gives back lengths only.

A task takes the texts of an Arrow batch, splits long ones, and packs the parts into encoder batches of about equal bytes, so
a batch of many short texts and one of a single very long text cost the same. The encoder's ids are counted and dropped.

A text may be split only where that changes no id. Two neighbouring characters that stand next to each other in no piece of
the model can never be joined, so the ids on both sides of such a place do not depend on each other. The encoder
puts a space mark before every string; a later part is therefore led by a guard, a character that no piece holds,
and the guard's own ids are taken off its count. A stretch without any such place stays in one part.
Splitting needs a model with byte fallback that leaves the characters as they are; under other models texts are encoded whole.

Defined results. A null text counts as the empty text: no bytes and no tokens. Strings of special tokens inside a text are
ordinary text, as the library has it. Whole texts of any length count. Repeated rows give repeated results, a null id stays
null, an empty table gives no rows, and only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a part of a long text before the next safe place ends it, and bytes of an encoder batch.
PART_CHARS = 1 << 16
BATCH_BYTES = 1 << 18
#: The mark that stands for a space inside pieces (a fixed value of the format).
SPACE_MARK = "▁"
#: Characters that may serve as guard, in order of choice.
GUARDS = "\n\x01\x02"


class Counter:
    """Counts tokens with one model; ``part_chars`` is the length above which a text is split."""

    def __init__(self, path: str, part_chars: int = PART_CHARS) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        #: Neighbouring characters inside some piece, in a text's own characters.
        self.inside = {pair for piece in pieces for pair in zip(piece.replace(SPACE_MARK, " "), piece.replace(SPACE_MARK, " ")[1:])}
        letters = {c for piece in pieces for c in piece}
        self.guard = next((c for c in GUARDS if c not in letters), None)
        # letters of several scripts and forms, and runs of space, which a normalising model would change
        probe = "A Ａ  ÅÅ ﬁ "
        plain = self.model.normalize(probe).replace(SPACE_MARK, " ") == " " + probe
        self.splits = plain and self.guard is not None and any(map(self.model.is_byte, ids))
        self.guard_tokens = len(self.model.encode(self.guard)) if self.splits else 0
        self.part_chars = part_chars

    def parts(self, text: str) -> list[str]:
        """The text, cut at safe places; every part but the first begins with the guard."""
        if len(text) <= self.part_chars or not self.splits:
            return [text]
        out, start, inside = [], 0, self.inside
        while len(text) - start > self.part_chars:
            end = start + self.part_chars
            while end < len(text) and (" " if text[end - 1] == SPACE_MARK else text[end - 1], " " if text[end] == SPACE_MARK else text[end]) in inside:
                end += 1
            if end == len(text):
                break
            out.append(text[start:end])
            start = end
        out.append(text[start:])
        return out[:1] + [self.guard + part for part in out[1:]]

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        owner: list[int] = []
        parts: list[str] = []
        for i, text in enumerate(texts):
            cut = self.parts(text)
            parts += cut
            owner += [i] * len(cut)
        out = np.zeros(len(texts), np.int64)
        for start, stop in batches(parts):
            counts = [len(ids) for ids in self.model.encode(parts[start:stop], num_threads=1)]
            np.add.at(out, owner[start:stop], counts)
        own, times = np.unique(owner, return_counts=True)
        out[own] -= (times - 1) * self.guard_tokens
        return out


def batches(parts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of parts, each of which ends with the part that brings it to ``limit`` bytes."""
    start, size = 0, 0
    for i, part in enumerate(parts, 1):
        # three bytes hold a character of nearly every script, and no string is encoded only to be measured
        size += len(part) if part.isascii() else 3 * len(part)
        if size >= limit:
            yield start, i
            start, size = i, 0
    if start < len(parts):
        yield start, len(parts)


_counters: dict[tuple[str, int], Counter] = {}


def counter(path: str, part_chars: int = PART_CHARS) -> Counter:
    """The counter of a model file, made once in each Python process."""
    if (path, part_chars) not in _counters:
        _counters[path, part_chars] = Counter(path, part_chars)
    return _counters[path, part_chars]


def token_counts(
    docs: DataFrame, model: str, *, limit: int = 4096, part_chars: int = PART_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; ``model`` is the path of the model file on every machine."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(model, part_chars)
        for batch in found:
            texts = pc.fill_null(batch.column("text"), "")
            counts = made.lengths(texts.to_pylist())
            sizes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
