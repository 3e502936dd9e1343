"""op5: against a plain search of all windows, with one block and with many."""

import hashlib
import random
import re

import pytest

from terralog.llm import decontamination
from terralog.llm.common import table

DOCS, ITEMS = "doc_id long, text string, spans string, items int, row int", "item_id long, text string, x int"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def plain(text, items):
    words, hit, ids = words_of(text), set(), set()
    for name, item in items:
        want = words_of(item)
        size = min(13, len(want))
        windows = {tuple(want[k : k + size]) for k in range(len(want) - size + 1)} if want else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                ids.add("" if name is None else str(name))
    joined = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(words), len(hit), len(ids), joined, bool(hit) and 20 * len(hit) >= len(words)


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def made(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "c", "É", "x1", "Of", "THE"]

    def text(n):
        return rng.choice([" ", "-", ", "]).join(rng.choices(pool, k=n))

    items = [(k, text(rng.choice([1, 2, 3, 7, 12, 13, 14, 30, 60]))) for k in range(6, 20)]
    items += [(3, ""), (4, None), (None, text(15)), (7, items[2][1])]
    docs = [None, "", " . ", *(text(rng.randrange(200)) for _ in range(60))]
    docs += [f"{text(40)} {rng.choice(items)[1]} {text(rng.randrange(300))}" for _ in range(60)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 40])
def test_against_plain_search(spark, seed, block_words):
    texts, items = made(seed)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    got = decontamination.marked(docs, bench, block_words=block_words)
    want = {i: plain(t, items) for i, t in enumerate(texts)}
    assert result(got) == want
    kept = decontamination.clean(docs, bench, block_words=block_words)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in want if not want[i][-1]]


def test_driver_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = result(decontamination.marked(docs, bench))
    some = [r for r in docs.collect() if r.doc_id % 3 == 0 or got[r.doc_id][1]]
    assert {r.doc_id: got[r.doc_id] for r in some} == {r.doc_id: plain(r.text, items) for r in some}
    assert any(x[-1] for x in got.values())


def test_empty_sides_and_repeats(spark):
    docs = spark.createDataFrame([(1, "one two three", "x", 1, 2)] * 3 + [(None, "one", None, None, None)], DOCS)
    bench = spark.createDataFrame([(9, "one two", 1)], ITEMS)
    none = bench.filter("item_id < 0")
    assert [r.contaminated for r in decontamination.marked(docs, none).collect()] == [False] * 4
    assert sorted(r.n_hit for r in decontamination.marked(docs, bench).collect()) == [0, 2, 2, 2]
    assert decontamination.marked(docs.filter("doc_id > 5"), bench).collect() == []
    assert decontamination.clean(docs, none).count() == 4


def test_jumps(spark):
    """A text without the benchmark's blocks is passed in jumps, not word by word."""
    table_13 = decontamination.Searcher(13, [("1", [b"w%d" % k for k in range(30)])])
    looked = []
    table_13.shift = type("Counted", (dict,), {"get": lambda self, *a: looked.append(1) or dict.get(self, *a)})(table_13.shift)
    assert list(table_13.find([b"x"] * 1200)) == [] and len(looked) <= 100
    assert list(table_13.find([b"w%d" % k for k in range(3, 18)])) == [(0, "1"), (1, "1"), (2, "1")]
