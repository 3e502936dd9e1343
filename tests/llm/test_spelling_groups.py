"""Near words, forms and roots against a plain comparison of all pairs."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from terralog.llm import spelling_groups
from terralog.llm.common import table

SCHEMA = "doc_id long, text string"


def plain_words(rows, damage=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v), default=None) for w, vs in near.items()}
    form = {w: v if v is not None and counts[v] >= 10 * counts[w] else None for w, v in best.items()}
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]])
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def made_texts(seed, letters, lengths, words, docs):
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(words)]
    for w in base[: words // 2]:
        k, c = rng.randrange(len(w) + 1), rng.choice(letters)
        base += [w[:k] + c + w[k:], w[: max(0, k - 1)] + w[k:], w[: max(0, k - 1)] + c + w[k:]]
    weights = [rng.choice([1, 1, 2, 30, 400]) for _ in base]
    return [(d, " ".join(w.title() if rng.random() < 0.2 else w for w in rng.choices(base, weights, k=60))) for d in range(docs)]


@pytest.mark.parametrize("group", [20_000, 3])
@pytest.mark.parametrize("letters, lengths", [("ab", range(7, 11)), ("abé", range(7, 9)), ("abcdefgÿ×", range(7, 30)), ("a", range(7, 30))])
def test_groups_equal_plain(spark, letters, lengths, group):
    rows = made_texts(3, letters, list(lengths), 150, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(spelling_groups.grouped(df, group=group)) == plain_groups(plain_words(rows))


def test_small_chunks_equal_one(spark, monkeypatch):
    rows = made_texts(5, "abcd", [7, 8, 9], 200, 40)
    words = spark.createDataFrame(list(plain_words(rows).items()), "word string, n long")
    found = spelling_groups.halves(words)
    one = sorted(map(tuple, spelling_groups.searched(found).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, spelling_groups.searched(found, chunk=10).collect())) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(spelling_groups, "AT_ONCE", 5)
    plain = plain_groups(plain_words(rows))
    total = Counter()
    for word, near, _, _ in one:
        total[word] += near
    assert total == Counter({w: x[3] for w, x in plain.items() if x[3]})


def test_each_word_finds_itself_nowhere():
    words = sorted({"aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaa", "aaabaaa"})
    rows = [(7, 3, 0, w, 2) for w in words if w.startswith("aaa")]
    found = spelling_groups.found_in(rows, True)
    assert {r[0]: r[1] for r in found} == {"aaaaaaa": 3, "aaaaaaaa": 1, "aaaaaaab": 1, "aaabaaa": 1}


def test_table_words_equal_plain(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    counts = {r.word: r.n for r in spelling_groups.vocabulary(docs).collect()}
    assert counts == plain_words(rows)


def test_odd_rows(spark):
    long = "x" * 3000 + "y" * 3000
    texts = [None, "", "123 --", "short words only", f"{long} {long}z {long[:-1]} {long}", "Straßen straßen STRASSEN", "ÉCOLIERS écoliers Écoliers", "naïveté́s naïvetés"]
    rows = [(k, t) for k, t in enumerate(texts)] * 2 + [(None, "nowhere nowhere anywhere")] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumn("word", spelling_groups.F.lit(1))
    assert got(spelling_groups.grouped(df)) == plain_groups(plain_words(rows))
    assert spelling_groups.grouped(df.limit(0)).count() == 0


def test_chain_of_forms(spark):
    words = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    rows = [(k, " ".join([w] * 10**e * 2)) for e, w in enumerate(words[:4], 0) for k in [e]]
    result = got(spelling_groups.grouped(spark.createDataFrame(rows, SCHEMA), damage=10**12))
    assert {w: r[1] for w, r in result.items()} == dict.fromkeys(words[:4], words[3])
