"""Token counts, whitening and hard negatives: odd rows, brute force, and the library they must match."""

from __future__ import annotations

import math

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparktraces.llm import hard_negatives as hard
from sparktraces.llm.hard_negatives import hard_negatives
from sparktraces.llm.queries import QUERIES, SQL
from sparktraces.llm.spectral import eigen, polar
from sparktraces.llm.token_counts import Counter, batches, token_counts
from sparktraces.llm.whitening import whitened
from tests.oracle import compare, connect

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


TEXTS = [
    "",
    " ",
    "   ",
    "hello  world",
    " leading and trailing  ",
    "<s> special </s> <unk> <0x41>",
    "tabs\tand\nlines\r\n\n\nend",
    "日本語のテキスト、句読点。" * 40,
    "▁▁ marks ▁ in text▁",
    "a\0b\x01\x02c",
    "été ÅÅ ﬁ ａｂｃ 🙂🙂‍🙂",
    "x" * 3000,
    "no-space-" * 500,
    " ".join(f"w{i}" for i in range(4000)),
    "  \n ".join(["alpha beta"] * 600),
    " " * 5000 + "end",
]


@pytest.mark.parametrize("part_chars", [1, 2, 7, 64, 1 << 16])
def test_split_texts_count_as_whole_ones(library, part_chars):
    made = Counter(MODEL, part_chars)
    assert made.splits
    assert made.lengths(TEXTS).tolist() == [len(library.encode(t)) for t in TEXTS]


def test_parts_cut_long_texts_and_hold_all_of_them():
    made = Counter(MODEL, 50)
    for text in TEXTS:
        parts = made.parts(text)
        assert parts[0] + "".join(p[1:] for p in parts[1:]) == text
    assert len(made.parts(TEXTS[13])) > 100
    assert len(made.parts(TEXTS[11])) < 70


def test_batches_are_balanced_by_bytes():
    parts = ["a" * 10] * 100 + ["b" * 1000] + ["c"] * 5
    found = list(batches(parts, 200))
    assert [i for a, b in found for i in range(a, b)] == list(range(len(parts)))
    assert max(sum(map(len, parts[a:b])) for a, b in found) <= 1200
    assert all(sum(map(len, parts[a:b])) >= 200 for a, b in found[:-1])
    assert list(batches([])) == []


def test_token_counts_of_odd_rows(spark, library):
    long = "very long text " * 8000
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None), (None, None, None, None, None), (99, long, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("n_tokens"), F.lit("x").alias("n_bytes"))
    found = sorted(map(tuple, token_counts(docs, MODEL, part_chars=100).collect()), key=str)
    expected = []
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or ""))
        expected.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert found == sorted(expected, key=str)
    assert token_counts(docs.limit(0), MODEL).collect() == []


def test_token_counts_query_against_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = sorted((d["doc_id"], len((d["text"] or "").encode()), len(library.encode(d["text"] or ""))) for d in docs)
    found = QUERIES["op11_token_counts"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in found)


def _spectra():
    rng = np.random.default_rng(5)
    turn, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    yield from (np.diag([5.0, 5, 5, 5, 1]), np.diag([1.0, 2, 3]), np.eye(4), np.ones((5, 5)), np.zeros((3, 3)), np.array([[7.0]]))
    yield (turn * 10.0 ** -np.arange(40)) @ turn.T
    yield (turn * np.r_[np.ones(20), np.zeros(20)]) @ turn.T
    x = rng.standard_normal((500, 40))
    yield x.T @ x


@pytest.mark.parametrize("a", list(_spectra()), ids=lambda a: f"{len(a)}")
def test_divide_and_conquer_finds_eigenvectors(a):
    values, vectors = eigen(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() / scale < 1e-14
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() / scale < 1e-14


def test_polar_factor_is_orthogonal():
    x = np.random.default_rng(1).standard_normal((30, 30))
    a = x + x.T
    u = polar(a)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13
    assert np.linalg.eigvalsh(u @ a).min() > -1e-12


def _brute_white(vectors, k):
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(width)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(width)) for r in x]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(width)] for r in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return deviation, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, explained = _brute_white([r["embedding"] for r in rows], 8)
    found = QUERIES["op12_whitening"](spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert found["deviation"].tolist() == [d for d in deviation for _ in range(8)]
    got = found["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-9
    assert np.abs(found["explained"].to_numpy().reshape(-1, 8) - explained).max() < 1e-12
    assert found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-10
    assert set(found["n"]) == {len(rows)}


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [[float(x) for x in np.round(rng.standard_normal(3) * (1, 5, 0.01), 3)] for _ in range(30)]
    rows = [(i, v, None) for i, v in enumerate(good)] + [(0, good[0], 1), (None, good[1], 1)]
    rows += [(90, None, 1), (91, [1.0, nan, 2.0], 1), (92, [1.0, inf, 2.0], 1), (93, [1.0, None, 2.0], 1), (94, [], 1), (95, [1.0, 2.0], 1), (96, [0.0, 0.0, 0.0], 1)]
    table = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("x"), F.lit(1).alias("component"), F.lit(1).alias("n"))
    found = whitened(table).toPandas()
    assert len(found) == 33 * 3 and set(found["component"]) == {1, 2, 3} and set(found["n"]) == {33}
    assert found["vec_id"].isna().sum() == 3 and (found["vec_id"] == 0).sum() == 6 and (found["vec_id"] == 96).sum() == 3
    assert found["identity_error"].max() < 1e-10
    deviation, white, _ = _brute_white([*good, good[0], good[1], [0.0, 0.0, 0.0]], 3)
    one = found[found["vec_id"] == 7].sort_values("component")
    assert one["deviation"].tolist() == [deviation[7]] * 3
    assert np.abs(np.abs(one["whitened"].to_numpy()) - np.abs(white[7])).max() < 1e-9
    assert whitened(table.limit(0)).collect() == []
    # one row, and rows without variance in some dimension
    alone = whitened(table.filter("vec_id = 5")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in alone] == [(None, None, None, 0)] * 3
    flat = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(5)], VECTORS)
    got = whitened(flat).orderBy("vec_id", "component").collect()
    assert [r["whitened"] is None for r in got] == [False, True] * 5
    assert abs(got[0]["whitened"]) == pytest.approx(math.sqrt(2)) and got[1]["explained"] == pytest.approx(0, abs=1e-12)
    # entries far beyond the others stay exact, or end at a defined bound
    huge = whitened(spark.createDataFrame([(1, [1e30, 1.0], 0), (2, [-1e12, 1.0], 0), (3, [0.5, 3.0], 0)], VECTORS)).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge)


def _brute_negatives(rows, every=100, k=10, positives=5):
    v = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, lab in rows]
    anchors: dict[int, tuple] = {}
    for i, lab, e in v:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (e, lab)), (e, lab))
    out = []
    for a, (e, lab) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(e, other)), i, other_lab) for i, other_lab, other in v if i != a)
        for p, pid, _ in [s for s in scored if s[2] == lab][:positives]:
            inside = [s for s in scored if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p][:k]
            out += [(a, pid, r, nid, -p, -n) for r, (n, nid, _) in enumerate(inside, 1)]
    return sorted(out)


def test_hard_negatives_query_against_sql_and_brute_force(spark, sf_dir):
    assert compare(QUERIES["op13_hard_negatives"](spark, sf_dir), connect(sf_dir), SQL["op13_hard_negatives"]) is None


@pytest.mark.parametrize("shape", ["clusters", "signs", "few", "long"])
def test_hard_negatives_against_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(hard, "LEAST_ROWS", 40)
    rng = np.random.default_rng(3)
    n, width = (400, 20) if shape != "few" else (12, 3)
    x = rng.standard_normal((n, width))
    labels = rng.integers(0, 3, n)
    if shape == "clusters":
        x = x * 0.2 + rng.standard_normal((4, width))[rng.integers(0, 4, n)]
    if shape == "signs":
        # ties, equal vectors, zero vectors, and a label that a third of the rows and no other anchor hold
        x, labels = np.sign(np.round(x)), np.where(np.arange(n) % 3, labels, 7)
        x[::5] = x[0]
        x[3] = 0
    if shape == "long":
        x *= 10.0 ** rng.integers(-2, 3, (n, 1))
    rows = [(int(i), [float(c) for c in v], int(lab)) for i, v, lab in zip(range(n), x, labels)]
    rows += [rows[5]] * 3 + [(200, rows[1][1], rows[1][2])]
    every = 20 if shape != "few" else 2
    found = hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), every=every)
    assert sorted(map(tuple, found.collect())) == _brute_negatives(rows, every)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.5, 0.2], 1), (3, [0.7, 0.0], 1), (4, [-1.0, 0.0], 1)]
    odd = [(None, [0.6, 0.0], 1), (5, None, 1), (6, [nan, 0.0], 1), (8, [inf, 0.0], 1), (9, [0.6, None], 1), (10, [0.6, 0.0], None), (11, [0.6], 1), (12, [], 0)]
    table = spark.createDataFrame(rows + odd, VECTORS).select("*", F.lit(1).alias("w"), F.lit(1).alias("score"), F.lit(1).alias("copies"))
    assert sorted(map(tuple, hard_negatives(table).collect())) == _brute_negatives(rows)
    assert hard_negatives(table.limit(0)).collect() == []
    assert hard_negatives(table.filter("label = 1")).collect() == []


def test_suffix_index_leaves_rows_and_dimensions_out():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.standard_normal((500, 32)) * (0.9 ** np.arange(32)))
    index = hard.SuffixIndex(np.arange(500), np.zeros(500, np.int64), np.ones(500, np.int64), x)
    first = index.level(0)[1]
    assert len(first[0]) < 500 and all(len(a) >= len(b) for a, b in zip(first, first[1:])) and len(first[-1]) < len(first[0])
    assert all(len(p) == 500 for p in index.level(hard.LEVELS)[1])
