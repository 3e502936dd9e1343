"""op8: exact sizes and slots, the matrix's sums and law, the same deal again."""

import zlib
from collections import Counter

import numpy as np

from terralog.llm import shards
from terralog.llm.common import table

SCHEMA = "doc_id long, text string, shard string, part int"


def dealt(spark, rows, n=16, parts=3, seed=shards.SEED):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return shards.dealt(docs, n, seed=seed).collect()


def whole(rows, want, n):
    """Every row once; sizes at most one apart; slots without gaps; sizes and checksums right."""
    count = Counter(r.shard for r in rows)
    sizes = [count[s] for s in range(n)]
    assert sum(sizes) == len(want) and max(sizes) - min(sizes) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(n) for k in range(sizes[s])]
    plain = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == plain
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}


def test_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 7)
    rows = [(i, f"text é {i}") for i in range(1003)] + [(None, None), (5, None), (5, ""), (5, "same")] + [(7, "same")] * 500
    got = dealt(spark, rows)
    whole(got, rows, 16)
    assert len({r.shard for r in got if r.doc_id == 7}) == 16  # a large group is spread


def test_few_rows_and_none(spark):
    whole(dealt(spark, [(1, "a"), (2, "b")]), [(1, "a"), (2, "b")], 16)
    empty = spark.createDataFrame([], SCHEMA)
    assert shards.dealt(empty, 16).collect() == []


def test_the_same_deal_again(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    first = shards.dealt(docs, 16).collect()
    assert sorted(first) == sorted(shards.dealt(docs, 16).collect())
    other = shards.dealt(docs, 16, seed=1).collect()
    assert {(r.doc_id, r.shard) for r in first} != {(r.doc_id, r.shard) for r in other}
    whole(first, [(r.doc_id, r.text) for r in docs.collect()], 16)


def test_matrix_sums():
    counts = [0, 5, 1000, 1, 333, 7]
    for seed in range(50):
        m = shards.matrix(counts, 16, seed)
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == shards.shard_sizes(sum(counts), 16).tolist()
        assert (m >= 0).all()


def test_matrix_follows_the_hypergeometric_law():
    """Mean and variance of one cell over many seeds."""
    cell = np.array([shards.matrix([40, 60], 4, seed)[0, 1] for seed in range(3000)])
    mean, var = 40 * 25 / 100, 40 * 0.25 * 0.75 * 60 / 99
    assert abs(cell.mean() - mean) < 0.15 and abs(cell.var() - var) < 0.5


def test_draws_beyond_numpy(monkeypatch):
    """The same law from the other way of drawing, and populations beyond numpy's bound."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(shards, "NUMPY_MOST", 0)
    got = np.array([shards.two_colours(rng, 30, 70, 40) for _ in range(20000)])
    want = np.random.default_rng(5).hypergeometric(30, 70, 40, 20000)
    assert abs(got.mean() - want.mean()) < 0.06 and abs(got.var() - want.var()) < 0.2
    many = np.array([shards.two_colours(rng, 2 * 10**9, 6 * 10**9, 10**6) for _ in range(2000)])
    assert abs(many.mean() - 250_000) < 40 and abs(many.std() / np.sqrt(10**6 * 0.1875) - 1) < 0.06


def test_slots_are_uniform(spark):
    """A row's place in the whole order does not depend on its place in the input."""
    n, sums = 64, np.zeros(64)
    docs = spark.createDataFrame([(i, str(i), "x", 1) for i in range(n)], SCHEMA).coalesce(1)
    for seed in range(12):
        for r in shards.dealt(docs, 4, seed=seed).collect():
            sums[r.doc_id] += r.shard * 16 + r.slot
    assert abs(np.corrcoef(np.arange(n), sums)[0, 1]) < 0.45
