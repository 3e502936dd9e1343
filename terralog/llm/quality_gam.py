"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and a few pairs of features have one over
their joint bins.  Tables are learned by cyclic boosting: shallow trees, one feature (or
pair) after the other and round after round, each fitted to what is still unexplained and
added to its table in small steps.  A score is an intercept plus one table entry per
feature and pair, put through the logistic function; whole batches are scored by index
and addition.

Features come from the text alone.  The model is fitted on at most ``TRAIN_ROWS`` labelled
documents, those with the smallest hash of their id, on the driver: that bound, not the
corpus, fixes the cost of fitting.  Scoring reads every document once, without a shuffle.

Defined results: a null or empty text is scored like any other, from zero features; every
input row gives one output row, repeated rows and null ids included (a null id is not
held out); without labels of both classes every score is the share of label 1, or 0.5
without any; an empty table gives an empty one; extra columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import sampled

TRAIN_ROWS = 20_000
KEEP_AT = 0.3
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.12
LEAVES = 3
SMOOTH = 4.0  # added to the curvature of a leaf, against leaves of few rows

FEATURES = (
    "words", "word_length", "symbols", "capitals", "shouts", "digits", "stops", "wide", "distinct", "doubled",
    "commonest_line", "line_words", "worst_line", "bars", "bare_words", "mixed_case",
)
SYMBOLS, SHOUTS, STOPS, DIGITS = b"#*$%&<>|~^@{}[]=\\_", b"!?", b".,;:", b"0123456789"
CAPITALS, SMALL = bytes(range(65, 91)), bytes(range(97, 123))
WIDE = bytes(range(128, 256))


def features(text: str | None) -> list[float]:
    """Plain shares and counts of a whole text, in the order of ``FEATURES``."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)

    def count(chars: bytes, within: bytes = data) -> int:
        return len(within) - len(within.translate(None, chars))

    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols, capitals, small = count(SYMBOLS), count(CAPITALS), count(SMALL)
    marks = SYMBOLS + SHOUTS
    worst = max((count(marks, x) + count(CAPITALS, x) / 2) / (len(x) + 20) for x in lines)
    return [
        np.log1p(n),
        (size - count(b" \t\n\x0b\x0c\r")) / n,
        symbols / size,
        capitals / (capitals + small + 1),
        count(SHOUTS) / n,
        count(DIGITS) / size,
        count(STOPS) / n,
        count(WIDE) / size,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        worst,
        words.count(b"|") / n,
        sum(1 for w in words if len(w) < 2) / n,
        min(capitals, small) / (capitals + small + 1),
    ]


class Model(NamedTuple):
    """Bin edges per feature, a table per feature, and pairs with their joint tables."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def coarse(bins: np.ndarray) -> np.ndarray:
    """The bins of pair tables."""
    return bins * PAIR_BINS // BINS


def logit_sum(model: Model, x: np.ndarray) -> np.ndarray:
    bins = binned(x, model.edges)
    total = np.full(len(x), model.intercept)
    for j, table in enumerate(model.tables):
        total += table[bins[:, j]]
    rough = coarse(bins)
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[rough[:, a], rough[:, b]]
    return total


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit_sum(model, x)))


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree over ordered bins: up to ``LEAVES`` leaves, best cut first."""
    leaves, out = [(0, len(g))], np.zeros(len(g))

    def gain(gs: np.ndarray, hs: np.ndarray) -> np.ndarray:
        return gs**2 / (hs + SMOOTH)

    while len(leaves) < LEAVES:
        best = (1e-9, None, 0)
        for a, b in leaves:
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            more = gain(left_g, left_h) + gain(all_g - left_g, all_h - left_h) - gain(all_g, all_h)
            k = int(np.argmax(more))
            if more[k] > best[0]:
                best = (more[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out


def quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of the best tree that cuts both sides of a joint table once."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(s: np.ndarray) -> list[np.ndarray]:
        top, left, rest = s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        a = s[:-1, :-1]
        return [a, top - a, left - a, rest - top - left + a]

    parts = list(zip(four(gs), four(hs), strict=True))
    more = sum(x**2 / (y + SMOOTH) for x, y in parts)
    i, j = np.unravel_index(int(np.argmax(more)), more.shape)
    step = [[float(x[i, j] / (y[i, j] + SMOOTH)) for x, y in parts[k : k + 2]] for k in (0, 2)]
    rows, columns = (np.arange(len(g)) > i).astype(int), (np.arange(g.shape[1]) > j).astype(int)
    return float(more[i, j]), np.array(step)[rows[:, None], columns[None, :]]


def fitted(x: np.ndarray, y: np.ndarray) -> Model:
    """Tables first for features, then for the pairs that explain most of the rest."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    empty = Model(0.0, edges, [np.zeros(BINS)] * width, [], [])
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return empty._replace(intercept=float(np.log(share / (1 - share))))
    bins = binned(x, edges)
    intercept = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), intercept)
    tables = [np.zeros(BINS) for _ in range(width)]

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            r, c = residuals()
            step = RATE * tree(np.bincount(bins[:, j], r, BINS), np.bincount(bins[:, j], c, BINS))
            tables[j] += step
            total += step[bins[:, j]]
    rough = coarse(bins)

    def joint(a: int, b: int) -> tuple[float, np.ndarray]:
        r, c = residuals()
        at, size = rough[:, a] * PAIR_BINS + rough[:, b], PAIR_BINS * PAIR_BINS
        return quarters(
            np.bincount(at, r, size).reshape(PAIR_BINS, -1), np.bincount(at, c, size).reshape(PAIR_BINS, -1)
        )

    ranked = sorted(((joint(a, b)[0], a, b) for a in range(width) for b in range(a + 1, width)), reverse=True)
    pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            step = RATE * joint(a, b)[1]
            pair_tables[k] += step
            total += step[rough[:, a], rough[:, b]]
    return Model(intercept, edges, tables, pairs, pair_tables)


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def is_held_out(key: int) -> bool:
    return zlib.crc32(str(key).encode()) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` documents that are not held out."""
    known = (
        labels.select(F.col("doc_id").alias("key"), F.col(label).alias("y"))
        .filter((fold(F.col("key")) != 0) & F.col("y").isin(0, 1))
        .groupBy("key")
        .agg(F.max("y").alias("y"))
    )
    chosen = sampled(known, "key", most, known.count())
    # At most ``most`` short rows, so this side is small whatever the corpus.
    plain = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = plain.join(F.broadcast(chosen), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["key", "y", "x"]
            )

    kind = plain.schema["key"].dataType.simpleString()
    rows = found.mapInArrow(run, f"key {kind}, y int, x array<double>")
    # An id that repeats in the corpus counts once.
    rows = rows.groupBy("key").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy("key").collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    return x, np.array([r.y for r in rows], float)


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Model:
    return fitted(*training_rows(docs, labels, label, most))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(model, x))], ["doc_id", "score"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_AT).cast("int").alias("predicted"),
    )
