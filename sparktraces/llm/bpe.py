"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be joined, so a text may
be cut there, its fragments encoded one by one, and the ids put together again. Texts are first cut where white space
follows other characters, which the word pattern of the vocabulary also never crosses, then into the pattern's
words, then at every forced pair. Fragments repeat a lot, so their ids are kept in a bounded table per task.

Defined results. A null text is encoded as the empty text: no ids. Added tokens in a text get their own id.
Whole texts of any length are encoded: a long fragment is merged in n log n steps. Repeated rows give
repeated results, an empty table none, and only the named columns are read.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the word pattern of byte-level vocabularies means it (the Unicode property).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Fixed word pattern of byte-level BPE vocabularies.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Fragments, and words, kept in each of two generations, and the longest that is kept; both bound memory and change no result.
KEPT_FRAGMENTS = 250_000
KEPT_LENGTH = 48
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_JOIN = 1 << 62
ROWS_PER_BATCH = 256


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _raw(token: str, alphabet: dict[str, int] = byte_alphabet()) -> bytes:
    return bytes(alphabet[c] for c in token)


class Decoder:
    """Bytes of every id of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            self._read(json.load(file))

    def _read(self, data: dict) -> None:
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: _raw(token) for token, i in data["model"]["vocab"].items()} | {i: t.encode() for t, i in self.special.items()}

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Codec(Decoder):
    """Encoder and decoder over one vocabulary file, with tables of at most ``kept`` known fragments, and words, in each generation."""

    def __init__(self, path: str, kept: int | None = None) -> None:
        self.kept = KEPT_FRAGMENTS if kept is None else kept
        super().__init__(path)

    def _read(self, data: dict) -> None:
        super()._read(data)
        self.ids = {_raw(token): i for token, i in data["model"]["vocab"].items()}
        self.first = [self.ids[bytes([b])] for b in range(256)]
        #: Rank and resulting id of a pair in one number, so that the least number is the next join.
        self.joins: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = map(_raw, merge if isinstance(merge, list) else merge.split(" "))
            self.joins[self.ids[left], self.ids[right]] = rank << ID_BITS | self.ids[left + right]
        self.inside = {pair for token in self.ids for pair in zip(token, token[1:])}
        self.words = regex.compile(WORDS).findall
        self.outer = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = _Known(self.fragment_ids, self.kept)
        self.words_known = _Known(self.word_ids, self.kept)

    def forced_fragments(self, word: bytes) -> list[bytes]:
        """The word cut at every byte pair that no token holds."""
        inside = self.inside
        ends = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in inside]
        if not ends:
            return [word]
        ends.append(len(word))
        return [word[a:b] for a, b in zip([0, *ends], ends)]

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: joins by rank, then from the left."""
        parts = [self.first[b] for b in fragment]
        if len(parts) > 64:
            return self._merged_long(parts)
        known = self.joins.get
        found = [known(pair, NO_JOIN) for pair in zip(parts, parts[1:])]
        while found and (best := min(found)) != NO_JOIN:
            i = found.index(best)
            parts[i : i + 2] = [new := best & ID_MASK]
            del found[i]
            if i:
                found[i - 1] = known((parts[i - 1], new), NO_JOIN)
            if i < len(found):
                found[i] = known((new, parts[i + 1]), NO_JOIN)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        joins, n = self.joins, len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(joins[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in joins]
        heapq.heapify(queue)
        while queue:
            join, i, pair = heapq.heappop(queue)
            j = after[i]
            if parts[i] < 0 or j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = join & ID_MASK, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (parts[a], parts[b])) in joins:
                    heapq.heappush(queue, (joins[p], a, p))
        return [p for p in parts if p >= 0]

    def fragment_ids(self, fragment: str) -> bytes:
        """Packed ids of an outer fragment."""
        plain = fragment.isascii() and (fragment if fragment[0] != " " else fragment[1:]).isalpha()
        return b"".join(map(self.words_known.__getitem__, (fragment,) if plain else self.words(fragment)))

    def word_ids(self, word: str) -> bytes:
        """Packed ids of one word of the pattern."""
        ids: list[int] = []
        for piece in self.forced_fragments(word.encode()):
            ids += self.merged(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        if self.added is not None and any(t in text for t in self.special):
            parts = self.added.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        self.known.trim()
        self.words_known.trim()
        return b"".join(map(self.known.__getitem__, self.outer(text)))


class _Known(dict):
    """Packed ids by text, in two generations; long texts are encoded but not kept."""

    def __init__(self, encode: Callable[[str], bytes], kept: int) -> None:
        self.encode, self.kept, self.older = encode, kept, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= KEPT_LENGTH:
            self[text] = ids
        return ids

    def trim(self) -> None:
        """Called between texts: a full generation becomes the older one."""
        if len(self) > self.kept:
            self.older = dict(self)
            self.clear()


_codecs: dict[tuple[str, int], Codec] = {}
_decoders: dict[str, Decoder] = {}


def codec(path: str, kept: int = KEPT_FRAGMENTS) -> Codec:
    """The codec of a vocabulary file, made once in each Python process."""
    if (path, kept) not in _codecs:
        _codecs[path, kept] = _decoders[path] = Codec(path, kept)
    return _codecs[path, kept]


def decoder(path: str) -> Decoder:
    """The decoder of a vocabulary file, made once in each Python process; a codec that is there already serves as one."""
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encoded(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT_FRAGMENTS) -> DataFrame:
    """(doc_id, n_tokens, ids) with ids packed as little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of the vocabulary file on every machine; ``kept`` bounds the memory of a task and changes no id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(vocabulary, kept)
        for batch in batches:
            for part in _slices(batch):
                ids = [made.encode(t or "") for t in part.column("text").to_pylist()]
                lengths = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lengths, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decoded(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of a result of `encoded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = decoder(vocabulary)
        for batch in batches:
            for part in _slices(batch):
                texts = pa.array([made.decode(x) for x in part.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = tokens.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS_PER_BATCH):
        yield batch.slice(start, ROWS_PER_BATCH)
