"""op3: components against all pairs, on copies, near copies, shared passages and odd rows."""

import random
from collections import Counter

import numpy as np
import pytest

from terralog.llm import ngram_join
from terralog.llm.common import table

SCHEMA = "doc_id long, text string, key string, hash int, row int"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(SMALL).split(" ") if text else []
    words = [w for x in words for w in x.split("\n") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(5)), strict=False))


def plain(rows):
    """``(doc_id, n_shingles, component_id)`` of every row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(ids.get(find(k), i), i)
    return [(i, len(s), ids.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def made(seed):
    """Texts near the threshold: copies with some words changed, common passages, short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    texts = [None, "", " \n ", "a", "A", "a b", "a b c d", "A b c d", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([6, 20, 45, 120]))
        for _ in range(rng.choice([1, 3, 9])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [f"{passage} {' '.join(rng.choices(words, k=rng.choice([2, 5, 8, 20])))}" for _ in range(25)]
    rng.shuffle(texts)
    return [(1000 - 3 * k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "block", "unit"), [(1, 384, 3000), (2, 4, 10), (3, 3, 40)])
def test_against_all_pairs(spark, monkeypatch, seed, block, unit):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", unit)
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    want = sorted(plain(rows), key=str)
    assert result(ngram_join.joined(docs)) == want
    kept = ngram_join.deduplicated(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in want if i == c)


@pytest.mark.parametrize("seed", [4, 5])
def test_every_link_is_found(spark, monkeypatch, seed):
    """All pairs of different sets at the threshold, across blocks and anchors, each once."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", 20)
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    pairs, members = ngram_join.linked_pairs(docs)
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    by_key = {bytes(r.key): sets[r.doc_id] for r in members.collect() if r.key is not None}
    got = [frozenset((by_key[bytes(r.key_a)], by_key[bytes(r.key_b)])) for r in pairs.collect()]
    every = sorted(set(sets.values()) - {frozenset()}, key=sorted)
    want = {frozenset((a, b)) for i, a in enumerate(every) for b in every[:i] if 100 * len(a & b) >= 80 * len(a | b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_one_large_group(spark, monkeypatch):
    """Near copies of one text in many blocks: chains of links are found across blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"v{k}" for k in range(100)]
    rows = []
    for k in range(120):
        copy = base[:]
        for p in rng.sample(range(100), rng.choice([0, 1, 2, 3, 4])):
            copy[p] = f"x{k}{p}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(4)
    assert result(ngram_join.joined(docs)) == sorted(plain(rows), key=str)


def test_a_call_does_not_grow_with_a_group(spark, monkeypatch):
    """Block pairs of a large group come one to a unit; no row is lost, small groups share units."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "UNIT_ROWS", 200)
    rows = [(1, k) for k in range(800)] + [(10 + k // 4, 1000 + k) for k in range(400)]
    got = ngram_join.units(spark.createDataFrame(rows, "anchor long, node long")).collect()
    assert len({(r.anchor, r.i, r.j, r.node) for r in got}) == len(got) == 800 * 100 + 400
    held, pairs = Counter(r.unit for r in got), {}
    for r in got:
        pairs.setdefault(r.unit, set()).add((r.anchor, r.i, r.j))
    assert max(held.values()) < 200
    assert all(len(p) == 1 for p in pairs.values() if any(a == 1 for a, _, _ in p))
    assert any(len(p) > 1 for p in pairs.values())


def test_repeated_ids_null_ids_and_empty(spark):
    text, other = " ".join("abcdefghij"), " ".join("klmnopqrst")
    rows = [(5, text), (5, text), (5, other), (None, text), (None, None), (3, other), (7, ""), (None, "z z z")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    assert result(ngram_join.joined(docs)) == sorted(plain(rows), key=str)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.deduplicated(docs).collect()), key=str)
    assert kept == sorted([(5, text), (3, other), (None, None), (7, ""), (None, "z z z")], key=str)
    assert result(ngram_join.joined(docs.filter("doc_id > 50"))) == []
    assert ngram_join.deduplicated(docs.filter("doc_id > 50")).collect() == []


def test_rows_of_one_id_meet_their_own_class(spark):
    """Different texts without an id: each row is shingled once more, not once per class."""
    base = [f"v{k}" for k in range(60)]
    rows = [(None, " ".join([*base[:k], "x", *base[k:]])) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    chosen = ngram_join.candidates(ngram_join.signatures(docs))
    assert chosen.count() == 40
    assert ngram_join.class_texts(docs, chosen).count() == 40
    assert result(ngram_join.joined(docs)) == sorted(plain(rows), key=str)


def test_overlap_counts(monkeypatch):
    monkeypatch.setattr(ngram_join, "TOKENS_AT_ONCE", 7)
    rng = np.random.default_rng(2)
    left = [np.unique(rng.integers(0, 60, 30)) for _ in range(9)]
    right = [np.unique(rng.integers(0, 60, 30)) for _ in range(5)]
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert ngram_join.overlap(left, right).tolist() == want
    own = ngram_join.overlap(left, None)
    assert all(own[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(left) for j, b in enumerate(left) if i != j)


def test_star_contraction(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [tuple(sorted(rng.sample(range(100, 200), 2))) for _ in range(70)]
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


def test_driver_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(ngram_join.joined(docs)) == sorted(plain(rows), key=str)
