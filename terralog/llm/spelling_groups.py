"""Spelling variant grouping: words one edit apart, found in bidirectional FM-indexes.

Words are counted over all texts.  Two words one edit apart agree on one half exactly, up
to a shift of their ends: if the first place where they differ lies behind the first half
of the shorter one, they share that half as a prefix, else the other half as a suffix.  So
each word goes to the groups of its halves, once as the shorter and once as the longer of
a pair.  A group with more than ``GROUP`` words is cut again in the same way, by half of
what is still open, until it is small or a single place is open (a few hundred words); no
pair is lost and no task holds more than a group and ``CHUNK`` rows.

A task indexes its words between delimiters, in reading order and reversed.  Its index
is the ranks of all suffixes and the symbols before them; a step of a search maps an
interval of ranks to that of the text with one more symbol in front.  A search starts at
the delimiter, matches the shared half exactly in the direction that meets it first, then
goes on across the other half with one error: at each place it branches into the symbols
that occur before the interval, or drops one of its own.  An interval with one rank left is the word itself and
ends.  The work of a word hangs on its length and the alphabet, not on the size of its group.

A pair is counted where the first difference lies, so each word adds up its near words
without their being written out; the most frequent one is its form.  Forms have at least
``RATIO`` times its occurrences, so chains are short; roots come by doubling the steps.

Defined results: a null text has no words; a null id counts as an empty one in the damage;
repeated rows count each; of equally frequent near words the first in code-point order is
the form; very long runs are words like any others; empty tables give empty ones; extra
columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import CAPITALS, SMALL, stored

LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGE = 7, 2, 10, 31
GROUP, CHUNK, AT_ONCE, REMEMBERED = 20_000, 60_000, 1_000_000, 400_000

RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
LOWER = str.maketrans(CAPITALS, SMALL)


def words_in(doc_id: object, text: str, damage: int) -> Iterator[tuple[str, int]]:
    """Words of a text with their counts, after damage."""
    head = ("" if doc_id is None else str(doc_id)) + ":"
    for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
        h = crc32((head + run).encode())
        if h % damage == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def vocabulary(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """``word, n`` of all words that occur often enough; counts are added up within tasks first."""
    plain = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                for word, n in words_in(doc_id, text.as_py(), damage):
                    counts[word] += n
                if len(counts) >= REMEMBERED:
                    yield flush()
                    counts.clear()
        yield flush()

    counted = plain.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def key_of(a: Column, p: Column, s: Column) -> Column:
    """A group: the shorter length, the known prefix and the known suffix."""
    word = F.col("word")
    return F.xxhash64(a, p, s, F.substring(word, F.lit(1), p), F.when(s > 0, F.substring(word, -s, s)))


def halves(words: DataFrame) -> DataFrame:
    """A row for each word and group: ``key, a, p, s, word, n``; ``a`` is the shorter length of the group's pairs."""
    length = F.length("word")
    lengths = F.filter(F.array(length, length - 1), lambda a: a >= LEAST_LENGTH)
    spread = words.select("word", "n", F.explode(lengths).alias("a"))
    half = F.floor(F.col("a") / 2).cast("int")
    none = F.lit(0)
    places = F.array(F.struct(half.alias("p"), none.alias("s")), F.struct(none.alias("p"), (F.col("a") - half).alias("s")))
    return keyed(spread.select("word", "n", "a", F.inline(places)))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.select(key_of(F.col("a"), F.col("p"), F.col("s")).alias("key"), "a", "p", "s", "word", "n")


def cut(rows: DataFrame, most: int) -> DataFrame:
    """Groups of more than ``most`` words cut in two by half of their open places, as often as needed."""
    open_ = F.col("a") - F.col("p") - F.col("s")
    while True:
        large = rows.where(open_ > 1).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most)
        large = stored(large, "large-groups")
        if large.isEmpty():
            return rows
        marked = rows.join(large.select("key", F.lit(True).alias("cut")), "key", "left")
        half = F.floor(open_ / 2).cast("int")
        kept = F.array(F.struct(F.col("p"), F.col("s")))
        parts = F.array(
            F.struct((F.col("p") + half).alias("p"), F.col("s")),
            F.struct(F.col("p"), (F.col("s") + open_ - half).alias("s")),
        )
        places = F.when(F.col("cut"), parts).otherwise(kept)
        rows = stored(keyed(marked.select("word", "n", "a", F.inline(places))), "cut-groups")


class Index:
    """Suffix ranks of words between delimiters, for stepping backwards."""

    def __init__(self, words: list[str]):
        """``words``: distinct, in code-point order."""
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        letters, t = np.unique(text, return_inverse=True)
        self.t, self.letters, size = t.astype(np.int64), len(letters) - 1, len(text)
        ends = np.flatnonzero(self.t == 0)
        self.start, self.stop = ends[:-1] + 1, ends[1:]
        # Delimiters rank by their place, so suffixes differ at the end of their word.
        rank = self.t + len(words)
        rank[ends] = np.arange(len(ends))
        longest, k = int((self.stop - self.start).max()) + 1, 1
        while k <= longest:
            behind = np.zeros(size, np.int64)
            behind[:-k] = rank[k:] + 1
            both = rank * (rank.max() + 2) + behind
            order = np.argsort(both, kind="stable")
            fresh = np.empty(size, np.int64)
            fresh[order] = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])
            rank, k = fresh, 2 * k
            if rank.max() == size - 1:
                break
        self.before = np.empty(size, np.int64)
        self.before[rank] = np.roll(self.t, 1)
        order = np.argsort(self.before, kind="stable")
        self.width = size + 1
        self.steps = self.before[order] * self.width + order

    def step(self, symbol: np.ndarray | int, at: np.ndarray) -> np.ndarray:
        """Rank of the first suffix that is ``symbol`` and one at or after rank ``at``."""
        return np.searchsorted(self.steps, symbol * self.width + at)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each interval, the symbols before it: interval number, symbol, new bounds."""
        wide = hi - lo > self.letters
        few, many = np.flatnonzero(~wide), np.flatnonzero(wide)
        sizes = (hi - lo)[few]
        of = np.repeat(few, sizes)
        ranks = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[of]
        symbols = self.before[ranks]
        pairs = np.unique((of * (self.letters + 1) + symbols)[symbols > 0])
        every = (many[:, None] * (self.letters + 1) + np.arange(1, self.letters + 1)).ravel()
        of, symbols = np.divmod(np.concatenate([pairs, every]), self.letters + 1)
        a, b = self.step(symbols, lo[of]), self.step(symbols, hi[of])
        some = b > a
        return of[some], symbols[some], a[some], b[some]

    def rest(self, word: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
        """Go on exactly with the first ``left`` letters of ``word``; pairs of query and word found, coded."""
        found = []
        while len(left):
            done = left == 0
            if done.any():
                a, b = self.step(0, lo[done]), self.step(0, hi[done])
                some = b > a
                found.append(query[done][some] * (len(self.start) + 1) + a[some])
                word, left, lo, hi, query = (x[~done] for x in (word, left, lo, hi, query))
            symbols = self.t[self.start[word] + left - 1]
            lo, hi = self.step(symbols, lo), self.step(symbols, hi)
            some = hi > lo
            word, left, lo, hi, query = word[some], left[some] - 1, lo[some], hi[some], query[some]
        return found

    def near(self, word: np.ndarray, a: np.ndarray, tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the words one edit away, numbers from 0, each pair once.

        A query is a word whose last ``tail`` and first ``head`` letters are matched
        exactly.  As long as ``a`` it meets its own length and one more, else one less.
        """
        m = self.stop[word] - self.start[word]
        query = np.arange(len(word))
        lo, hi = np.zeros(len(word), np.int64), np.full(len(word), len(self.start) + 1)
        waiting: list[tuple[np.ndarray, ...]] = []
        found: list[np.ndarray] = []

        def settle() -> None:
            found.extend(self.rest(*(np.concatenate(x) for x in zip(*waiting, strict=True))))
            waiting.clear()

        done = 0
        while len(query):
            left = m[query] - done
            at = np.flatnonzero((tail[query] <= done) & (m == a)[query])
            if len(at):
                of, symbols, new_lo, new_hi = self.branches(lo[at], hi[at])
                q, r = query[at[of]], left[at[of]]
                waiting.append((word[q], r, new_lo, new_hi, q))
                other = (r > head[q]) & (self.t[self.start[word[q]] + np.maximum(r - 1, 0)] != symbols)
                waiting.append((word[q][other], r[other] - 1, new_lo[other], new_hi[other], q[other]))
            at = np.flatnonzero((tail[query] <= done) & (m != a)[query] & (left > head[query]))
            if len(at):
                q = query[at]
                waiting.append((word[q], left[at] - 1, lo[at], hi[at], q))
            if sum(len(x[0]) for x in waiting) >= AT_ONCE:
                settle()
            on = left > head[query]
            query, lo, hi, left = query[on], lo[on], hi[on], left[on]
            symbols = self.t[self.start[word[query]] + left - 1]
            lo, hi = self.step(symbols, lo), self.step(symbols, hi)
            # One rank is the word itself.
            more = (hi - lo > 1) | (tail[query] > done + 1)
            query, lo, hi, done = query[more], lo[more], hi[more], done + 1
        if waiting:
            settle()
        q, v = np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *found])), len(self.start) + 1)
        return q, v - 1


def found_in(rows: list[tuple[int, int, int, str, int]], backwards: bool) -> list[tuple[str, int, int, str]]:
    """For rows ``a, p, s, word, n`` of whole groups: word, number of near words, count and text of the best."""
    counts = {w: n for _, _, _, w, n in rows}
    turned = (lambda w: w[::-1]) if backwards else (lambda w: w)
    ordered = sorted(map(turned, counts))
    index, number = Index(ordered), {w: k for k, w in enumerate(ordered)}
    plain = [turned(w) for w in ordered]
    n_of = np.array([counts[w] for w in plain], np.int64)
    place = np.empty(len(plain), np.int64)
    place[sorted(range(len(plain)), key=plain.__getitem__)] = np.arange(len(plain))
    a, p, s = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    word = np.array([number[turned(r[3])] for r in rows], np.int64)
    query, near = index.near(word, a, p if backwards else s, s if backwards else p)
    # With a known suffix, pairs that agree on all before it are counted by the prefix.
    ends = (a - s).tolist()
    keep = [
        not suffix or plain[w][: ends[q]] != plain[v][: ends[q]]
        for q, w, v, suffix in zip(query.tolist(), word[query].tolist(), near.tolist(), s[query].tolist(), strict=True)
    ]
    query, near = query[np.array(keep, bool)], near[np.array(keep, bool)]
    order = np.lexsort((place[near], -n_of[near], query))
    query, near = query[order], near[order]
    who, first, times = np.unique(query, return_index=True, return_counts=True)
    best = near[first]
    return [(rows[q][3], c, int(n_of[v]), plain[v]) for q, c, v in zip(who.tolist(), times.tolist(), best.tolist(), strict=True)]


def searched(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``word, near, best_n, best``: what each word finds in each of its groups, if anything."""
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
            every = list(zip(*(t.column(c).to_pylist() for c in ("a", "p", "s", "word", "n")), strict=True))
            for backwards in (False, True):
                part = [r for r in every if (r[1] > r[2]) == backwards]
                if part:
                    columns = list(zip(*found_in(part, backwards), strict=True)) or [[]] * 4
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["word", "near", "best_n", "best"])

        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) >= chunk:
                t = pa.Table.from_batches(waiting)
                keys = t.column("key").to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))
                if whole:
                    yield from made(t.slice(0, whole))
                    waiting = t.slice(whole).combine_chunks().to_batches()
        if waiting:
            yield from made(pa.Table.from_batches(waiting))

    return dealt.mapInArrow(run, "word string, near long, best_n long, best string")


def rooted(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``, following forms to the last; each round doubles the steps."""
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        both = steps.join(further, "root", "left")
        steps = stored(
            both.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots"
        )
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def grouped(docs: DataFrame, damage: int = DAMAGE, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    words = stored(vocabulary(docs, damage), "words")
    found = searched(cut(halves(words), group))
    none = F.lit(None).cast("string")
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), none.cast("long").alias("best_n"), none.alias("best"))
    every = own.unionByName(found, allowMissingColumns=True).groupBy("word").agg(
        F.max("n").alias("n"),
        F.sum("near").alias("n_near"),
        F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best")))).alias("best"),
    )
    enough = -F.col("best.less") >= RATIO * F.col("n")
    table = stored(
        every.select(
            "word", "n", "n_near", F.when(enough, F.col("best.best")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    roots = rooted(table.where(F.col("form").isNotNull()))
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
