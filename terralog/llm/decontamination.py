"""Benchmark decontamination by Wu-Manber search for many windows at once, over words.

The windows of a benchmark, 13 words each or the whole of a shorter item, are the test
strings.  A shift table tells for every block of two words how far the search may jump
because no window ends there; most places of a clean text are passed 12 words at a time.
Where a block may end a window, the bucket of that block and of the window's first block
names the few windows to compare word by word.  Windows shorter than 13 words are
searched for each length on its own.

The benchmark is read item by item and goes to the tasks in blocks of at most
``BLOCK_WORDS`` words; each block is one pass over the texts in the same task, without a
shuffle, and after every ``CHAIN`` blocks the work is stored.  So neither the driver nor a
task holds more than a bounded part, whatever the benchmark's size.

Defined results: a null or empty text has no words and is not contaminated; an item
without words has no window; an item without an id counts with the empty id, items of
one id as one; every input row gives one output row, repeated rows included; empty
tables on either side are fine; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import released, stored

WINDOW = 13
#: A document is contaminated when this share of its words is hit: 20 * n_hit >= n_words.
SHARE = 20
BLOCK_WORDS = 500_000
CHAIN = 4

#: Byte by byte: capitals become small, what is no part of a word becomes a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Searcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, items: list[tuple[str, list[bytes]]]):
        self.length, self.items = length, items
        self.block = min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[int, int]]]] = {}
        for k, (_, words) in enumerate(items):
            for end in range(self.block - 1, len(words)):
                at = tuple(words[end - self.block + 1 : end + 1])
                # The first window that holds this block ends at the window's length, or here.
                far = max(0, length - 1 - end)
                self.shift[at] = min(far, self.shift.get(at, far))
                if not far:
                    start = end - length + 1
                    first = tuple(words[start : start + self.block])
                    self.buckets.setdefault(at, {}).setdefault(first, []).append((k, start))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, str]]:
        """Start and item id of every occurrence."""
        length, block, most, n = self.length, self.block, self.most, len(words)
        shift, end = self.shift.get, length - 1
        while end < n:
            at = tuple(words[end - block + 1 : end + 1])
            jump = shift(at, most)
            if jump:
                end += jump
                continue
            start = end - length + 1
            bucket = self.buckets[at].get(tuple(words[start : start + block]), ())
            if bucket:
                here = words[start : end + 1]
                for k, a in bucket:
                    name, item = self.items[k]
                    if item[a : a + length] == here:
                        yield start, name
            end += 1


def searchers(items: list[tuple[str, str]]) -> list[Searcher]:
    by_length: dict[int, list[tuple[str, list[bytes]]]] = {}
    for name, text in items:
        words = words_of(text)
        if words:
            by_length.setdefault(min(WINDOW, len(words)), []).append((name, words))
    return [Searcher(length, by_length[length]) for length in sorted(by_length)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in lists of items of bounded size; the driver holds one at a time."""
    part, size = [], 0
    plain = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    for name, text in plain.toLocalIterator():
        n = len(words_of(text))
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((name, text))
        size += n
    yield part




def search(df: DataFrame, block: Broadcast) -> DataFrame:
    """Add a block's finds to ``spans``, ``items`` and ``n_words``; other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searchers(block.value)
        for b in batches:
            names = b.schema.names
            spans, items, n_words = [], [], []
            before = zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)
            for text, (old, known) in zip(b.column("text"), before, strict=True):
                words = words_of(text.as_py())
                found = list(zip(old[::2], old[1::2], strict=True))
                ids = set(known)
                for table in tables:
                    for start, name in table.find(words):
                        found.append((start, start + table.length))
                        ids.add(name)
                n_words.append(len(words))
                spans.append([x for span in merged(found) for x in span])
                items.append(sorted(ids))
            made = {"spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            made["n_words"] = pa.array(n_words, pa.int64())
            yield pa.RecordBatch.from_arrays([made.get(c, b.column(c)) for c in names], names)

    return df.mapInArrow(lambda batches: released(run(batches)), df.schema)


def searched(docs: DataFrame, benchmark: DataFrame, row: Column, text: Column, item_cols: tuple[str, str], most: int) -> DataFrame:
    """``row, text, spans, items, n_words`` with the finds of all blocks."""
    nothing = F.lit(0).cast("long")
    df = docs.select(
        row.alias("row"),
        text.alias("text"),
        F.array().cast("array<long>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        nothing.alias("n_words"),
    )
    context = docs.sparkSession.sparkContext
    for k, block in enumerate(blocks(benchmark, *item_cols, most)):
        if k and k % CHAIN == 0:
            df = stored(df, "searched")
        df = search(df, context.broadcast(block))
    return df


def n_hit() -> Column:
    """Words inside any occurrence: the lengths of the merged spans."""
    sign = F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(sign, F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(hit: Column, n_words: Column) -> Column:
    return (hit > 0) & (SHARE * hit >= n_words)


def marked(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_cols: tuple[str, str] = ("item_id", "text"),
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items`` of every document."""
    df = searched(docs, benchmark, F.col(id_col), F.col(text_col), item_cols, block_words)
    return df.select(F.col("row").alias("doc_id"), "n_words", n_hit().alias("n_hit"), "items").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        "items",
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    df = searched(docs, benchmark, F.struct("*"), F.col(text_col), ("item_id", "text"), block_words)
    return df.filter(~contaminated(n_hit(), F.col("n_words"))).select("row.*")


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), item_at AS (
  SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0
), item_window AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS words FROM item_at
), sizes AS (SELECT DISTINCT size FROM item_window),
doc_at AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size
), hit AS (
  SELECT doc_id, p, i.size, item_id FROM (SELECT *, array_to_string(w[p : p + size - 1], ' ') AS words FROM doc_at) x
  JOIN item_window i ON x.size = i.size AND x.words = i.words
), hit_word AS (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS k FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM hit_word GROUP BY doc_id),
found AS (
  SELECT doc_id, list(item ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""
