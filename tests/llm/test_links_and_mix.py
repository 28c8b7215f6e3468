"""Families of near copies larger than a block, ids with several texts, and mixes of rows without proper ids."""

from __future__ import annotations

import collections
import os

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparktraces.llm import jaccard_join
from sparktraces.llm.jaccard_join import jaccard_components, one_per_component
from sparktraces.llm.mixing import mix_plan
from sparktraces.llm.shingles import shingle_set
from sparktraces.operators import stage

DOCS = "doc_id long, text string"


def shingles(text, width):
    words = (text or "").lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, width, percent):
    """Least id that links reach; rows that share an id are one document."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = collections.defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for token in s:
            lists[token].append(n)
    for n, (i, s) in enumerate(sets):
        same = collections.Counter(m for token in s for m in lists[token] if m < n)
        for m, both in same.items():
            if 100 * both >= percent * (len(s) + len(sets[m][1]) - both):
                a, b = top(i), top(sets[m][0])
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i, _ in sets}


def families(seed):
    """A large family of near copies of one text, chains whose ends do not link, and texts with a passage in common."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(1 << 40)}"
    base = [word() for _ in range(60)]
    rows = []
    for _ in range(90):
        text = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 3)):
            text[at] = word()
        rows.append(" ".join(text))
    step = [word() for _ in range(80)]
    for _ in range(40):
        step = list(step)
        step[rng.integers(0, 80)] = word()
        rows.append(" ".join(step))
    passage = " ".join(word() for _ in range(15))
    rows += [passage + " " + " ".join(word() for _ in range(rng.integers(1, 30))) for _ in range(60)]
    rows += [" ".join(word() for _ in range(rng.integers(1, 6))) for _ in range(20)] + ["", "one", "one two", "ONE two", None]
    order = rng.permutation(len(rows)).tolist()
    return [(i, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("width,percent,block", [(4, 85, 16), (5, 80, 128)])
def test_large_families_match_brute_force(spark, monkeypatch, width, percent, block):
    # small blocks and cells, so that groups have several of both
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 20)
    rows = families(block)
    found = jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), width=width, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows, width, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(shingles(t, width)) for i, t in rows}


def test_texts_of_one_id_are_one_document(spark):
    x, y = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, x), (5, x), (5, y), (9, y + " c"), (None, x), (None, "z"), (7, "z")]
    found = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, DOCS)).collect())
    assert found == collections.Counter({(1, 1): 1, (5, 1): 2, (9, 1): 1, (None, None): 2, (7, 7): 1})
    kept = sorted(((r["doc_id"], r["text"]) for r in one_per_component(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert kept == sorted([(1, x), (None, x), (None, "z"), (7, "z")], key=str)


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_mix_reaches_targets_whatever_the_ids(spark, ids):
    docs = spark.range(3000).select(
        (F.when(F.col("id") % 3 != 0, F.col("id")) if ids == "null" else F.when(F.col("id") % 2 == 0, 4).otherwise(F.col("id")) if ids == "one" else F.col("id")).alias("doc_id"),
        F.concat(F.lit("a b c d e f g h i "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 10 < 3, "big").otherwise("small").alias("source"),
    )
    taken, targets = collections.Counter(), {}
    for r in mix_plan(docs, keep=("source",)).collect():
        taken[r["source"]] += r["size"] * r["copies"]
        targets[r["source"]] = r["target"]
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.03)


def test_a_quoted_passage_forms_no_group(spark):
    """Unrelated texts that quote one passage stay apart, near copies together, and a large family of one text in one group."""
    rng = np.random.default_rng(7)
    words = lambda n: [f"w{rng.integers(1 << 40)}" for _ in range(n)]
    passage, base = words(40), words(60)
    quoting = [" ".join(words(60) + passage) for _ in range(60)]
    family = [" ".join([*base[:i], "x" + str(i), *base[i + 1 :]]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(quoting + family)), DOCS)
    profiles = jaccard_join._profiles(docs, 4, 85, jaccard_join.frequent_shingles(docs, 4)).select("doc_id", "gid").collect()
    sizes = collections.Counter(r["gid"] for r in profiles if r["doc_id"] < 60)
    assert max(sizes.values()) <= 2
    assert max(collections.Counter(r["gid"] for r in profiles if r["doc_id"] >= 60).values()) > 30
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs, width=4, percent=85).collect()}
    assert got == brute_components(list(enumerate(quoting + family)), 4, 85)


def test_groups_far_apart_in_size_are_no_partners(spark, monkeypatch):
    compared, plain = [], jaccard_join._qualifying
    monkeypatch.setattr(jaccard_join, "_qualifying", lambda pairs, percent: compared.append(pairs.select("q", "g").collect()) or plain(pairs, percent))
    row = lambda gid, n: (gid, n, gid, 1, jaccard_join._bit_row(np.arange(n, dtype=np.uint64)).tolist())
    classes = spark.createDataFrame([row(1, 100), row(2, 20), row(3, 95)], "cno long, n int, gid long, copies long, bits array<long>")
    shared = spark.createDataFrame([(t, g) for t in range(15) for g in (1, 2, 3)], "token long, gid long")
    stands = {r["gid"]: r["stands"] for r in jaccard_join._groups(classes, shared, 85).collect()}
    assert [tuple(p) for p in compared[0]] == [(3, 1)] and stands == {1: None, 2: None, 3: 1}


def test_texts_are_not_shuffled_for_many_wanted_sets(spark, monkeypatch):
    """More wanted classes than a broadcast holds: their ids still go to the texts, in several passes."""
    monkeypatch.setitem(stage.lookup_side.__kwdefaults__, "limit", 3)
    monkeypatch.setattr(jaccard_join, "NARROW_ROWS", 3, raising=False)
    plans, mapped = [], jaccard_join._mapped

    def spy(rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return mapped(rows, *rest)

    monkeypatch.setattr(jaccard_join, "_mapped", spy)
    rows = [(i, f"a{i} b{i % 3} c d e{i} f") for i in range(12)] + [(2, "one more text of an id"), (None, "x y z")]
    texts = stage.staged(spark.createDataFrame(rows, DOCS))
    digests = {i: xxhash.xxh3_128_digest(shingle_set(t, 2).tobytes()) for i, t in reversed(rows)}
    wanted = [(100 + i, i, digests[i], 5, 1, 4, False, i == 3, None, False) for i in range(8)]
    place = "gid long, size long, hi int, centre boolean, main boolean, stands long, stood boolean"
    wanted = spark.createDataFrame(wanted, f"cno long, rep long, cid binary, {place}")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = jaccard_join._sets(texts, wanted, 2).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans and not any("Exchange hashpartitioning" in p for p in plans)
    assert sorted((r["cno"], r["main"], bytes(r["tokens"])) for r in found) == [
        (100 + i, i == 3, jaccard_join._packed(shingle_set(rows[i][1], 2))) for i in range(8)
    ]


def test_links_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    """Small limits of broadcast tables; prefixes of all texts that are gone by then."""
    monkeypatch.setitem(stage.lookup_side.__kwdefaults__, "limit", 5)
    monkeypatch.setattr(jaccard_join, "NARROW_ROWS", 60, raising=False)
    rows = families(5)
    before = list(stage._created)
    found = jaccard_components(spark.createDataFrame(rows, DOCS), width=3, percent=80).collect()
    want = brute_components(rows, 3, 80)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want
    left = [p for p in stage._created if p not in before]
    assert left and not any("prefix" in spark.read.parquet(p).columns for p in left)


def test_discarded_tables_are_deleted_and_others_stay(spark):
    gone, kept = stage.staged(spark.range(3)), stage.staged(spark.range(4))
    path = gone.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    stage.discard(gone)
    assert not os.path.exists(f"/{path.lstrip('/')}") and kept.count() == 4
    assert not any(p.endswith(path.rsplit("/", 1)[-1]) for p in stage._created)
