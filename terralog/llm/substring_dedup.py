"""Substring dedup with fixed-block anchors: words in repeats of ``WINDOW`` words go where an earlier document has them.

1. Texts of the same words are one class; all but the one of least id are removed whole.
   Screening: of every window's 10-word pieces the least hash is kept, about one in twenty.  A
   window whose least piece is in no other class repeats nowhere, so the steps below see
   only texts and places that share one.
2. Index: every class is cut into non-overlapping blocks of ``BLOCK`` words.  A window holds
   a whole block of any document that it repeats in.  The index has a row per distinct
   block, with its earliest place.
3. Probe: every rolling window of ``BLOCK`` words is looked up; what an earlier document
   has as a block is a hit.
4. Extension: hits ``BLOCK`` words apart that lead to neighbouring blocks of one document
   are a chain, equal throughout.  Beyond the ends of chains, windows around a hit are
   compared with the windows around all blocks of that hash, by two 64-bit hashes and the
   least id, so a repeat is followed to its last word whichever document has it, and no
   pairs of documents are written out.

A block that a third of all documents hold is one row in the index; its probes and the
windows around it are rows of a join that Spark can split, and their least id is taken
within tasks first.

Defined results: a null or blank text has no words and keeps the hash of the empty text;
texts under ``WINDOW`` words keep all; rows of one id never remove each other, with the
same or with other texts; a null id counts as later than all others and removes nothing;
very long texts are hashed whole, in memory proportional to one text; empty tables give
empty ones; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terralog.llm.common import stored

WINDOW, BLOCK, PIECE = 50, 25, 10
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NOTHING = sha256(b"").hexdigest()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(words: list[bytes], lengths: tuple[int, ...], base: int = BASES[0]) -> list[np.ndarray]:
    """Hashes of all runs of each of the ascending ``lengths``, by start; longer runs are made of shorter ones."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    parts = {1: mixed(h * np.uint64(base))}

    def of(length: int) -> np.ndarray:
        if length not in parts:
            whole = max(k for k in parts if k < length)
            a = whole if 2 * whole >= length else 1 << (length.bit_length() - 1 - (length.bit_count() == 1))
            left, right = of(a), of(length - a)
            n = max(0, len(words) - length + 1)
            parts[length] = left[:n] * np.uint64(pow(base, length - a, 1 << 64)) + right[a : a + n]
        return parts[length]

    return [mixed(of(k)) for k in lengths]


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size, out = 1, h
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(h) - width + 1], out[width - size :][: len(h) - width + 1])


def screens(words: list[bytes]) -> np.ndarray:
    """The least piece of each window, by its start."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64)
    return least(rolling(words, (PIECE,))[0], WINDOW - PIECE + 1)


def near_open(open_: np.ndarray, n: int) -> np.ndarray:
    """Starts of blocks that are the first block of an open window in some division: one starts up to BLOCK - 1 before."""
    grown = np.concatenate([[0], np.cumsum(np.concatenate([open_, np.zeros(n - BLOCK + 1 - len(open_), bool)]))])
    at = np.arange(n - BLOCK + 1)
    return grown[at + 1] > grown[np.maximum(at - BLOCK + 1, 0)]


def mapped(df: DataFrame, schema: str, each: Callable[..., Iterator[tuple]], most: int = 100_000) -> DataFrame:
    """Rows that ``each`` makes of the values of a row; arrays of numbers may come as columns of equal length."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = list(types)
        for b in batches:
            rows, size = [], 0
            for values in zip(*(b.column(k) for k in range(b.num_columns)), strict=True):
                for made in each(*(v.as_py() for v in values)):
                    rows.append(made)
                    size += len(made[0]) if isinstance(made[0], np.ndarray) else 1
                if size >= most:
                    yield batch(rows, kinds)
                    rows, size = [], 0
            if rows:
                yield batch(rows, kinds)

    def batch(rows: list[tuple], kinds: list[pa.Field]) -> pa.RecordBatch:
        if not isinstance(rows[0][0], np.ndarray):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)]
        else:
            sizes = [len(r[0]) for r in rows]
            columns = []
            for f, c in zip(kinds, zip(*rows, strict=True), strict=True):
                if isinstance(c[0], np.ndarray):
                    columns.append(pa.array(np.concatenate(c), f.type))
                else:
                    columns.append(pa.array(c, f.type).take(pa.array(np.repeat(np.arange(len(c)), sizes))))
        return pa.RecordBatch.from_arrays(columns, types.names)

    return df.mapInArrow(run, schema)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_words, digest, whole, screen``: the hash of all words, and the screening pieces."""
    plain = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    kind = plain.schema["doc_id"].dataType.simpleString()

    def each(doc_id, text_hash, text):
        words = words_of(text)
        joined = b" ".join(words)
        kept = np.unique(screens(words)).view(np.int64)
        yield doc_id, text_hash, len(words), xxhash.xxh3_128_digest(joined), sha256(joined).hexdigest(), kept

    schema = f"doc_id {kind}, text_hash long, n_words long, digest binary, whole string, screen array<long>"
    return mapped_rows(plain, schema, each)


def mapped_rows(df: DataFrame, schema: str, each: Callable[..., Iterator[tuple]]) -> DataFrame:
    """As ``mapped``, for rows that are no columns."""
    return mapped(df, schema, lambda *values: iter(tuple(each(*values))), 1_000)


def later(than: Column, doc_id: Column) -> Column:
    """Whether ``doc_id`` comes after ``than``, which is no null; null comes last."""
    return than.isNotNull() & (doc_id.isNull() | (than < doc_id))


def candidates(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``digest, doc_id, text, shared``: one text of each class that shares a screening piece with another."""
    pieces = classes.select("digest", F.explode("screen").alias("piece"))
    shared = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1).select("piece")
    marks = pieces.join(shared, "piece").groupBy("digest").agg(F.collect_list("piece").alias("shared"))
    marks = marks.join(classes.select("digest", "first"), "digest")
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("_hash"), "text")
    met = texts["doc_id"].eqNullSafe(F.col("first.doc_id")) & (F.col("_hash") == F.col("first.text_hash"))
    return texts.join(marks, met).select("digest", texts["doc_id"], "text", "shared")


class Text:
    """Words of a candidate, the windows that may repeat, and hashes of its blocks."""

    def __init__(self, text: str, shared: list[int]):
        self.words = words_of(text)
        self.n = len(self.words)
        pieces = np.sort(np.array(shared, np.int64).view(np.uint64))
        least_ = screens(self.words)
        at = np.minimum(np.searchsorted(pieces, least_), len(pieces) - 1)
        self.open = pieces[at] == least_

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the rolling blocks that an open window may begin with."""
        at = np.flatnonzero(near_open(self.open, self.n))
        return at, rolling(self.words, (BLOCK,))[0][at].view(np.int64)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows that start at ``at``."""
        one, two = (rolling(self.words, (WINDOW,), base)[0][at].view(np.int64) for base in BASES)
        return one, two


def probes(texts: DataFrame, aligned: bool) -> DataFrame:
    """``h, digest, doc_id, at``: rolling blocks, or with ``aligned`` only those of the fixed division."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def each(digest, doc_id, text, shared):
        at, h = Text(text, shared).blocks()
        if aligned:
            fixed = at % BLOCK == 0
            at, h = at[fixed], h[fixed]
        yield h, digest, doc_id, at

    return mapped(texts, f"h long, digest binary, doc_id {kind}, at long", each)


def chained(hits: list[tuple[int, bytes, int]]) -> list[tuple[int, int]]:
    """Ascending spans that chains of hits cover, at least a window each."""
    ref = {at: (digest, there) for at, digest, there in hits}
    spans: list[list[int]] = []
    for at in sorted(ref):
        digest, there = ref[at]
        if ref.get(at + BLOCK) == (digest, there + BLOCK):
            if spans and spans[-1][1] >= at:
                spans[-1][1] = max(spans[-1][1], at + 2 * BLOCK)
            else:
                spans.append([at, at + 2 * BLOCK])
    return [tuple(s) for s in spans]


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:n]) > 0


def asked(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """``digest, doc_id, spans, anchors, at, one, two``: what chains cover, and the windows still to compare."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = hits.groupBy("digest").agg(F.collect_list(F.struct("at", "ref", "there")).alias("hits"))

    def each(digest, doc_id, text, shared, hits):
        t = Text(text, shared)
        hits = [(x["at"], x["ref"], x["there"]) for x in hits]
        spans = chained(hits)
        bare = np.concatenate([[0], np.cumsum(~covered(t.n, spans))])
        near = np.zeros(t.n + 1, np.int64)
        places = np.unique(np.array([x[0] for x in hits], np.int64))
        near[places] = 1
        near = np.concatenate([[0], np.cumsum(near)])
        x = np.arange(len(t.open))
        want = t.open & (bare[x + WINDOW] > bare[x]) & (near[x + BLOCK] > near[x])
        at = np.flatnonzero(want)
        one, two = t.windows(at)
        # The blocks that stand first in a window asked for.
        count = np.concatenate([[0], np.cumsum(np.concatenate([want, np.zeros(t.n - len(want), bool)]))])
        anchors = places[count[places + 1] > count[np.maximum(places - BLOCK + 1, 0)]]
        h = rolling(t.words, (BLOCK,))[0][anchors].view(np.int64)
        yield digest, doc_id, [s for span in spans for s in span], np.unique(h), at, one, two

    schema = f"digest binary, doc_id {kind}, spans array<long>, anchors array<long>, at array<long>, one array<long>, two array<long>"
    return mapped_rows(texts.join(found, "digest"), schema, each)


def held(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``one, two, least``: windows around the blocks at ``places``, and the least id that has each."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = places.groupBy("digest").agg(F.collect_list("at").alias("places"))

    def each(digest, doc_id, text, shared, places):
        t = Text(text, shared)
        x = np.unique((np.array(places, np.int64)[:, None] - np.arange(BLOCK)).ravel())
        x = x[(x >= 0) & (x < len(t.open))]
        x = x[t.open[x]]
        one, two = t.windows(x)
        yield one, two, doc_id

    rows = mapped(texts.join(found, "digest"), f"one long, two long, doc_id {kind}", each)
    return rows.groupBy("one", "two").agg(F.min("doc_id").alias("least"))


def cut_out(texts: DataFrame, asks: DataFrame, windows: DataFrame) -> DataFrame:
    """``digest, n_removed, spans, kept``: repeats of each candidate and the hash of what stays."""
    found = windows.groupBy("digest").agg(F.collect_list("at").alias("found"))
    known = asks.select("digest", "spans").join(found, "digest", "left")

    def each(digest, doc_id, text, shared, spans, found):
        words = words_of(text)
        every = [*zip(spans[::2], spans[1::2], strict=True), *((x, x + WINDOW) for x in found or ())]
        gone = covered(len(words), every)
        kept = b" ".join(w for w, out in zip(words, gone.tolist(), strict=True) if not out)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        yield digest, int(gone.sum()), edge, sha256(kept).hexdigest()

    return mapped_rows(texts.join(known, "digest"), "digest binary, n_removed long, spans array<long>, kept string", each)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` of every row.

    ``spans`` are starts and ends, in words, of the maximal stretches removed.
    """
    signed = stored(signatures(docs), "signatures")
    least_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = signed.where(F.col("n_words") >= WINDOW).groupBy("digest").agg(
        F.min(least_id).alias("first"), F.first("screen").alias("screen")
    )
    classes = stored(classes, "classes")
    texts = stored(candidates(docs, classes).dropDuplicates(["digest"]), "candidates")
    blocks = stored(probes(texts, True), "blocks")
    # Aggregates are stored before they are joined: Spark splits a hot key only between two shuffles of the join's own.
    index = blocks.where(F.col("doc_id").isNotNull()).groupBy("h").agg(F.min(F.struct("doc_id", "at", "digest")).alias("ref"))
    index = stored(index, "index")
    hits = probes(texts, False).join(index, "h").where(later(F.col("ref.doc_id"), F.col("doc_id"))).select(
        "digest", "at", F.col("ref.digest").alias("ref"), F.col("ref.at").alias("there")
    )
    asks = stored(asked(texts, hits), "asks")
    anchors = asks.select("doc_id", F.explode("anchors").alias("h")).groupBy("h").agg(
        F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("none")
    )
    anchors = stored(anchors, "anchors")
    wanted = F.col("doc_id").isNotNull() & (F.col("none") | (F.col("doc_id") < F.col("last")))
    windows = stored(held(texts, blocks.join(anchors, "h").where(wanted).select("digest", "at")), "windows")
    each = asks.select("digest", "doc_id", F.inline(F.arrays_zip("at", "one", "two")))
    met = each.join(windows, ["one", "two"]).where(later(F.col("least"), F.col("doc_id"))).select("digest", "at")
    removed = cut_out(texts, asks, met)
    known = classes.select("digest", F.col("first.doc_id").alias("first")).join(removed, "digest", "left")
    rows = signed.drop("screen", "text_hash").join(stored(known, "known"), "digest", "left")
    copy = later(F.col("first"), F.col("doc_id"))
    spans = F.when(copy, F.array(F.lit(0).cast("long"), F.col("n_words"))).otherwise(F.coalesce("spans", F.array().cast("array<long>")))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, NOTHING).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
        spans.alias("spans"),
    )


SQL = r"""
WITH texts AS (
    SELECT doc_id, row_number() OVER () AS nth, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
    SELECT nth, doc_id, unnest(range(1, len(words) - 48)) AS place, words FROM texts WHERE len(words) >= 50
), windows AS (
    SELECT nth, doc_id, place, md5(array_to_string(list_slice(words, place, place + 49), ' ')) AS w FROM places
), earliest AS (
    SELECT w, min(doc_id) AS first FROM windows GROUP BY w
), gone AS (
    SELECT DISTINCT nth, place + k AS place
    FROM (SELECT nth, place FROM windows JOIN earliest USING (w) WHERE first < doc_id), range(50) AS r(k)
), each AS (
    SELECT nth, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
), kept AS (
    SELECT nth, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS words FROM each ANTI JOIN gone USING (nth, place) GROUP BY nth
)
SELECT doc_id, len(texts.words) AS n_words, len(texts.words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (nth)
"""
