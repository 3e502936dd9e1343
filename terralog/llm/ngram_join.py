"""N-gram Jaccard join by vertical partitioning, and the components of its links.

Texts are sets of 5-word shingles; two link at a Jaccard similarity of 0.8 or more.  Equal
sets are one class, so copies cost nothing beyond a row each.  The join is exact:

1. A similar pair lacks at most a fifth of either side's shingles.  Counted over the
   shingles whose hash lies below a fixed bound, a text that shares too few of them with
   any other has no link; most texts end here.  Shingles seen twice within a batch are
   settled there, so a frequent one moves once per batch, not once per text.
2. For the texts left, all shingles are ordered by document frequency, rarest first, ties
   by hash.  A similar pair shares one within the first fifth of both (prefix filter).
3. The texts that share such a shingle meet in the group of an anchor, the text of that
   list with the fewest shingles of its own.  A text is sent to its few anchors, not to
   each of its lists, and no pair is written out.
4. The order is cut into fragments.  Groups are compared block by block: a matrix of
   partial overlaps for each fragment, summed over the fragments where it is made.  Pairs
   that reach the threshold are links, and a block pair returns only links that join two
   of its texts not yet connected there: fewer than it has texts.
5. Components come from star contraction on these links.

A group of any size is cut into blocks of about ``BLOCK`` texts, so no task holds a group.
Shingles are compared as 64-bit hashes, classes as 128-bit digests of all their hashes.

Defined results: a null or blank text has no shingle, no link and itself as component;
every input row gives one output row; rows of one id with different texts are classes of
their own; a null id is never the smallest; empty tables give empty ones; extra columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralog.llm.common import CAPITALS, SMALL, released, stored

WORDS, PERCENT = 5, 80
SAMPLE = int(0.3 * 2**64)
FRAGMENTS = 4
BLOCK = 384
UNIT_ROWS = 3000
BROADCAST_ROWS = 300_000
TOKENS_AT_ONCE = 1024

LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().translate(LOWER).split()
    size = min(WORDS, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        x = h[k : k + n]
        total += (x ^ (x >> np.uint64(31))) * MIX[k]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(32)))


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


SIGNED = "doc_id {kind}, text_hash long, key binary, n long, batch long, settled long, open array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """A row per document, and one per batch (``n`` = -1) of the sampled shingles that two classes in it share.

    The first document of a class in a batch has ``open``, its sampled shingles that no
    other class in the batch has, and ``settled``, the number of those that one has.
    """
    plain = docs.select(
        F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash")
    )
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, b in enumerate(batches):
            keys, counts, sampled, first = [], [], [], {}
            for text in b.column("text"):
                tokens = shingles(text.as_py())
                key = digest(tokens) if len(tokens) else None
                if key is not None and key not in first:
                    first[key] = len(keys)
                    sampled.append(tokens[: np.searchsorted(tokens, np.uint64(SAMPLE))])
                keys.append(key)
                counts.append(len(tokens))
            every = np.concatenate(sampled) if sampled else np.zeros(0, np.uint64)
            values, times = np.unique(every, return_counts=True)
            twice = values[times > 1]
            settled, open_ = [None] * len(keys), [None] * len(keys)
            for k, tokens in zip(first.values(), sampled, strict=True):
                alone = np.isin(tokens, twice, invert=True, assume_unique=True)
                settled[k], open_[k] = int((~alone).sum()), tokens[alone].view(np.int64)
            pad = 1 if len(twice) else 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column("doc_id"), pa.nulls(pad, b.column("doc_id").type)]),
                    pa.concat_arrays([b.column("text_hash"), pa.nulls(pad, pa.int64())]),
                    pa.array(keys + [None] * pad, pa.binary()),
                    pa.array(counts + [-1] * pad, pa.int64()),
                    pa.array([part << 24 | nth] * (len(keys) + pad), pa.int64()),
                    pa.array(settled + [None] * pad, pa.int64()),
                    pa.array(open_ + [twice.view(np.int64)] * pad, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "key", "n", "batch", "settled", "open"],
            )

    return plain.mapInArrow(lambda batches: released(run(batches)), SIGNED.format(kind=kind))


def candidates(signed: DataFrame) -> DataFrame:
    """``key, rep, text_hash`` of the classes that may have a link: enough of their sampled shingles occur elsewhere.

    ``rep`` and ``text_hash`` are of one document of the class.
    """
    short = F.xxhash64("key")
    posted = signed.filter(F.size("open") > 0).select(
        F.when(F.col("key").isNotNull(), short).alias("class"), "batch", F.explode("open").alias("token")
    )
    same = Window.partitionBy("token")
    seen = posted.select(
        "class",
        "batch",
        (
            (F.min("class").over(same) != F.max("class").over(same)) | (F.count("class").over(same) < F.count("*").over(same))
        ).alias("shared"),
    )
    shared = seen.filter(F.col("shared") & F.col("class").isNotNull()).groupBy("class", "batch").agg(F.count("*").alias("met"))
    firsts = signed.filter(F.col("settled").isNotNull()).withColumn("class", short)
    enough = F.col("settled") + F.coalesce("met", F.lit(0)) >= F.col("settled") + F.size("open") - F.floor(F.col("n") / WORDS)
    passed = firsts.join(shared, ["class", "batch"], "left").withColumn("enough", enough)
    least = F.min(F.struct("doc_id", "text_hash"))
    classes = passed.groupBy("key").agg(least.alias("one"), F.min("enough").alias("enough")).filter("enough")
    return classes.select("key", F.col("one.doc_id").alias("rep"), F.col("one.text_hash").alias("text_hash"))


def class_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``text, key`` of the documents that have the id and the text of a chosen class's document."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash"))
    # Three short columns; by hint only below a bound on their number, else as Spark decides.
    small = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("text_hash"))
    return plain.join(small, same).select("text", "key")


def full_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``node, key, n, tokens``: all shingles of the chosen classes, from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sets = [], []
            for text, key in zip(b.column("text"), b.column("key").to_pylist(), strict=True):
                tokens = shingles(text.as_py())
                if digest(tokens) == key:  # texts of one id may have equal hashes
                    keys.append(key)
                    sets.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                ["key", "n", "tokens"],
            )

    made = class_texts(docs, chosen).mapInArrow(lambda batches: released(run(batches)), "key binary, n long, tokens array<long>")
    sets = made.dropDuplicates(["key"])
    return sets.select(F.monotonically_increasing_id().alias("node"), "key", "n", "tokens")


def ordered(sets: DataFrame) -> DataFrame:
    """``node, n, token, place, at``: shingles that two classes share, by the global order.

    ``place`` compares shingles in that order; ``at`` is the position in the class's own
    order, whose first positions are those of the shingles nobody shares.  Classes that
    share too few are left out.
    """
    posted = sets.select("node", "n", F.explode("tokens").alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    mine = Window.partitionBy("node")
    place = F.shiftleft("df", 32) + F.shiftrightunsigned("token", 32)
    rows = posted.join(often, "token").withColumn("place", place).withColumn("common", F.count("*").over(mine))
    rows = rows.filter(F.col("n") - F.col("common") <= F.floor(F.col("n") / WORDS))
    rank = F.row_number().over(mine.orderBy("place", "token"))
    return rows.select("node", "n", "token", "place", (F.col("n") - F.col("common") + rank - 1).alias("at"), "common")


#: Bits of ``monotonically_increasing_id`` used in one comparison with the count before them.
ID_BITS = 53


def groups(postings: DataFrame) -> DataFrame:
    """``anchor, node``: the texts that share a prefix shingle meet at its anchor."""
    prefix = postings.filter(F.col("at") <= F.floor(F.col("n") / WORDS))
    own = F.least(F.col("n") - F.col("common"), F.lit(1023))
    lists = prefix.select("token", "node", (F.shiftleft(own, ID_BITS) + F.col("node")).alias("order"))
    anchors = lists.groupBy("token").agg(F.min("order").alias("order"), F.count("*").alias("size")).filter("size > 1")
    anchors = anchors.select("token", F.col("order").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("anchor"))
    return lists.select("token", "node").join(anchors, "token").select("anchor", "node").distinct()


def units(members: DataFrame) -> DataFrame:
    """``unit, anchor, i, j, side, node``: each group cut into blocks, each block sent to its pairs of blocks.

    A ``unit`` is what one call compares: a block pair of a group of several blocks, or
    whole groups of one block, about ``UNIT_ROWS`` rows with their fragments.
    """
    sizes = members.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cut = members.join(sizes, "anchor").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    many = max(1, members.count() * FRAGMENTS // UNIT_ROWS)
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return pairs.select(
        F.when(F.col("blocks") > 1, F.xxhash64("anchor", i, j)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(many))).alias("unit"),
        "anchor",
        i.alias("i"),
        j.alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        "node",
    )


def overlap(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Number of tokens that each left and right set have in common; ``right`` None: left with left."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = times[token] > 1
    owner, token = owner[useful], token[useful]
    _, token = np.unique(token, return_inverse=True)
    out = np.zeros((len(left), len(right) if right is not None else len(left)), np.float32)
    for low in range(0, int(token.max()) + 1 if len(token) else 0, TOKENS_AT_ONCE):
        here = (token >= low) & (token < low + TOKENS_AT_ONCE)
        m = np.zeros((len(sets), TOKENS_AT_ONCE), np.float32)
        m[owner[here], token[here] - low] = 1
        out += m[: len(left)] @ (m[len(left) :] if right is not None else m).T
    return out.astype(np.uint32)


def by_unit(table: pa.Table) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each ``anchor, i, j`` of a table."""
    table = table.sort_by([("anchor", "ascending"), ("i", "ascending"), ("j", "ascending")])
    ids = np.stack([table.column(c).to_numpy() for c in ("anchor", "i", "j")], axis=1)
    cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
        yield tuple(map(int, ids[a])), table.slice(a, b - a)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``a`` and ``b`` connect, as few as possible, as stars."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in list(root) if find(x) != x]


def unit_links(table: pa.Table, every: bool) -> pa.Table:
    """Sum the overlaps of each block pair over the fragments; links between pairs that reach the threshold.

    ``every`` link, or a forest of them.
    """
    found: list[tuple[int, int]] = []
    for (_, i, j), part in by_unit(table):
        node, size, right, fragment = (part.column(c).to_numpy() for c in ("node", "n", "side", "fragment"))
        sets = [np.asarray(t.values) for t in part.column("tokens").combine_chunks()]
        ids_a, first_a = np.unique(node[right == 0], return_index=True)
        ids_b, first_b = np.unique(node[right == (i != j)], return_index=True)
        size_a, size_b = size[right == 0][first_a], size[right == (i != j)][first_b]
        total = np.zeros((len(ids_a), len(ids_b)), np.uint32)
        for f in np.unique(fragment):
            here, there = (np.flatnonzero((fragment == f) & (right == side)) for side in (0, i != j))
            if len(here) and len(there):
                at, to = np.searchsorted(ids_a, node[here]), np.searchsorted(ids_b, node[there])
                others = None if i == j else [sets[k] for k in there]
                total[np.ix_(at, to)] += overlap([sets[k] for k in here], others)
        either = size_a[:, None] + size_b[None, :] - total.astype(np.int64)
        x, y = np.nonzero((100 * total.astype(np.int64) >= PERCENT * either) & (total > 0))
        other = ids_a[x] != ids_b[y]
        a, b = ids_a[x][other], ids_b[y][other]
        found += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True) if every else forest(a, b)
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def links(sets: DataFrame, every: bool = False) -> DataFrame:
    """``a, b``: links between classes, each once; ``every`` one, or enough to connect what they connect."""
    postings = stored(ordered(sets), "postings")
    members = stored(groups(postings), "members")
    pairs = units(members)
    cuts = postings.agg(
        F.percentile_approx("place", [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000).alias("cuts")
    ).first()["cuts"] or []
    fragment = sum((F.when(F.col("place") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    segments = postings.withColumn("fragment", fragment).groupBy("node", "n", "fragment").agg(F.collect_list("token").alias("tokens"))
    work = pairs.join(segments, "node").select("unit", "anchor", "i", "j", "side", "node", "n", "fragment", "tokens")
    return work.groupBy("unit").applyInArrow(lambda table: unit_links(table, every), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with a link; ``root`` is the least node reachable.

    Large-star and small-star steps in turn until the links no longer change.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    edges = stored(edges, "links")
    last = mark(edges)
    while last[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = stored(small.filter("a < b").distinct(), "links")
        now = mark(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored signatures of all documents, and the shingle sets of the classes that may have a link."""
    signed = stored(signatures(docs.select("doc_id", "text")), "signatures")
    return signed, stored(full_sets(docs, stored(candidates(signed), "candidates")), "sets")


def linked_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole join: ``key_a, key_b`` of every two classes that link, and ``doc_id, key`` of all documents.

    A class is all documents of one set of shingles, so copies are not multiplied out;
    there are as many pairs as there are links between different sets.
    """
    signed, sets = classes_of(docs)
    named = sets.select("node", "key")
    found = links(sets.select("node", "n", "tokens"), every=True)
    for side in ("a", "b"):
        found = found.join(named.select(F.col("node").alias(side), F.col("key").alias(f"key_{side}")), side)
    return found.select("key_a", "key_b"), signed.filter("n >= 0").select("doc_id", "key")


def joined(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_hash, component`` of every document.

    ``component`` names the component where ids cannot: the least class digest in it.
    """
    signed, sets = classes_of(docs)
    roots = components(links(sets.select("node", "n", "tokens")))
    rows = signed.filter("n >= 0").select("doc_id", "text_hash", "key", "n")
    first = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    linked = sets.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = linked.join(first, "key").select("key", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"), F.min("key").alias("component"))
    # As below: a join key made after the aggregate, so that a large component can be split.
    whole = F.col("root").cast("string")
    least = least.select(whole.alias("name"), "least", "component")
    classes = linked.withColumn("name", whole).join(least, "name").select("key", "least", "component")
    classes = first.join(classes, "key", "left").select(
        "key",
        F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("least"),
        F.coalesce("component", "key").alias("component"),
    )
    # A key made after the last aggregate: the join then has shuffles of its own, and Spark
    # can split a class that holds many of the rows.
    apart = F.concat(F.lit(b"k"), F.col("key"))
    classes = classes.select(apart.alias("class"), "least", F.col("component"))
    return rows.withColumn("class", apart).join(classes, "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        "text_hash",
        "component",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each component.

    The document with the smallest id stays (of rows of one id, the smallest hash of the
    text); documents without words are linked with nothing and all stay.
    """
    rows = stored(joined(docs).filter("n_shingles > 0"), "joined")
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stay = rows.groupBy("component").agg(F.min(named).alias("best"))
    best = stay.select("component", "best.doc_id", "best.text_hash")
    same = [rows["component"] == best["component"], rows["doc_id"].eqNullSafe(best["doc_id"])]
    others = rows.join(best, [*same, rows["text_hash"] == best["text_hash"]], "left_anti")
    # The row travels as one struct, so its columns may have any names.
    here = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    kept = matching(here, others, "left_anti")
    # The kept id and text may stand in several rows.
    copies = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    copies = copies.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    same_row = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    again = best.join(copies, same_row, "left_semi")
    if again.limit(1).count():
        repeated = matching(kept, again, "left_semi").dropDuplicates(["id", "hash"])
        kept = matching(kept, again, "left_anti").unionByName(repeated)
    return kept.select("row.*")


def matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents by id and hash of the text, nulls equal."""
    rows = rows.select("doc_id", "text_hash").distinct()
    return docs.join(rows, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), how)


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), spot AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0
), s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS shingle FROM spot),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.other = edge.x
)
SELECT reach.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""
