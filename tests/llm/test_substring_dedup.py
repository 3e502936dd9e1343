"""Removed words against a plain reading of the contract, on texts made of repeated passages."""

import random
from hashlib import sha256

import pytest

from terralog.llm import substring_dedup
from terralog.llm.common import table

SCHEMA = "doc_id long, text string"


def plain(rows):
    texts = [(d, [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]) for d, t in rows]
    first = {}
    for d, words in texts:
        for x in range(len(words) - 49):
            key = tuple(words[x : x + 50])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, words in texts:
        gone = set()
        for x in range(len(words) - 49):
            f = first.get(tuple(words[x : x + 50]))
            if f is not None and (d is None or f < d):
                gone.update(range(x, x + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((d, len(words), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    rows = substring_dedup.deduplicated(df).collect()
    for r in rows:
        assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)


def passages(seed, docs, letters="abcdefgh", lengths=(10, 24, 25, 26, 40, 49, 50, 51, 60, 74, 75, 76, 99, 100, 120)):
    """Texts of fresh words and of pieces cut out of common passages, at any place."""
    rng = random.Random(seed)
    fresh = lambda n: ["".join(rng.choices(letters, k=5)) for _ in range(n)]
    common = [fresh(200) for _ in range(4)]
    common.append(["same"] * 200)
    common.append((["tick", "tock"] * 100)[:150])
    rows = []
    for d in range(docs):
        words = []
        for _ in range(rng.randrange(5)):
            p, n = rng.choice(common), rng.choice(lengths)
            a = rng.randrange(max(1, len(p) - n))
            words += p[a : a + n]
            words += fresh(rng.choice([0, 0, 1, 3, 30]))
        rows.append((d, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_passages_equal_plain(spark, seed):
    rows = passages(seed, 120)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_few_letters_equal_plain(spark):
    rows = passages(9, 60, letters="ab", lengths=(49, 50, 51, 75, 130))
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_near_copies_equal_plain(spark):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdef", k=6)) for _ in range(700)]
    rows = []
    for d in range(60):
        words = list(base)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = ["edit" + str(rng.random())] * rng.randrange(3)
        rows.append((d, " ".join(words[rng.randrange(40) :])))
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "few words"), (5, long), (6, "x " + long[2000:9000] + "\v y"), (None, long[:4000]), (None, long[:4000])]
    rows += [(7, long[:3000]), (7, long[:3000]), (7, long[1000:5000]), (8, "é è " * 60), (9, "é è " * 60), (-1, long[100_000:101_000])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", substring_dedup.F.lit(1)).withColumn("digest", substring_dedup.F.lit("x"))
    assert got(df) == plain(rows)
    assert got(df.limit(0)) == []


def test_text_ids(spark):
    rows = [(str(d), t) for d, t in passages(4, 40)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert got(df) == plain(rows)


def test_table_equals_plain(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    result = plain(rows)
    assert sum(r[2] for r in result) > 1000
    assert got(docs) == result


@pytest.mark.parametrize("length", range(1, 60))
def test_rolling_hashes_tell_runs_apart(length):
    rng = random.Random(length)
    words = [rng.choice([b"a", b"b"]) for _ in range(300)]
    h = substring_dedup.rolling(words, (length,))[0]
    runs = [tuple(words[k : k + length]) for k in range(300 - length + 1)]
    assert len(h) == len(runs)
    seen = {}
    for value, run in zip(h.tolist(), runs, strict=True):
        assert seen.setdefault(value, run) == run
    assert len(seen) == len(set(runs))
