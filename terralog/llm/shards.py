"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Shard sizes are fixed beforehand, at most one row apart.  How many rows of each source
partition go to each shard is then drawn exactly as a uniform shuffle of all rows would
have it: multivariate hypergeometric, one source partition after another from what the
shards still lack.  Inside a partition the rows are put in random order and dealt to the
shards in these numbers; in the shard they are put in random order again, which gives the
slots.  Every one of the n! orders is equally likely, and sizes are exact, not expected.

Only ids, sizes and checksums move; texts are read once.  These rows are stored with
their source partition and place in it, and every random key is a hash of seed, partition
and place, so a task that is run again makes the same rows.  The matrix has a row per
source partition and a column per shard.  Slots are counted per shard and range of
the random key, some thousand rows each, so no task orders a whole shard.

Law: ``rows``.  Groups of equal texts are spread like all rows; sizes could not be exact
otherwise.

Defined results: a null text has size 1 and the checksum of nothing; every input row gets
one slot, repeated rows and null ids included; an empty table gives an empty one; extra
columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralog.llm.common import stored

SEED = 20_240_901
#: About so many rows of a shard are put in order together.
BUCKET_ROWS = 5_000
#: numpy draws from fewer than this.
NUMPY_MOST = 10**9
LAW = "rows"


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that add up to ``rows``, the larger ones first."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def matrix(counts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows of partition p that go to shard s; row sums are ``counts``, column sums the shard sizes."""
    rng = np.random.default_rng(seed)
    lack = shard_sizes(sum(counts), shards)
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        out[p] = drawn(rng, lack, n)
        lack = lack - out[p]
    return out


def drawn(rng: np.random.Generator, lack: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``n`` from ``lack``, as one two-colour draw per shard."""
    got, rest, left = np.zeros(len(lack), np.int64), int(lack.sum()), n
    for s, have in enumerate(map(int, lack)):
        rest -= have
        got[s] = left if not rest else two_colours(rng, have, rest, left)
        left -= int(got[s])
    return got


def two_colours(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Draw ``n`` without putting back; how many are good."""
    if n == 0 or good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    # Beyond numpy's bound: drawn as if put back, accepted by the ratio of the two laws,
    # which is greatest about the mean.
    every = good + bad

    def ratio(x: int) -> float:
        return log_shrink(good, x) + log_shrink(bad, n - x) - log_shrink(every, n)

    middle = n * good // every
    most = max(ratio(x) for x in range(max(0, middle - 2), min(n, middle + 3) + 1))
    while True:
        x = int(rng.binomial(n, good / every))
        if rng.random() < math.exp(min(0.0, ratio(x) - most)):
            return x


def log_shrink(have: int, x: int) -> float:
    """log of have (have - 1) ... (have - x + 1) / have ** x."""
    if x > have:
        return -math.inf
    if have < 10**6:
        return math.lgamma(have + 1) - math.lgamma(have - x + 1) - x * math.log(have) if x else 0.0
    if x == have:
        return log_shrink(have, x - 1) - math.log(have)
    less = math.log1p(-x / have)  # the sum of log(1 - i / have) by Euler and Maclaurin
    return -(have - x) * less - x - less / 2 + (1 / have - 1 / (have - x)) / 12


def key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def dealt(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.monotonically_increasing_id()
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftright(number, 33).cast("int").alias("part"),
            number.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        ),
        "rows",
    )
    spark = docs.sparkSession
    counts = [(r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    buckets = max(1, sum(n for _, n in counts) // (shards * BUCKET_ROWS))
    ends = np.cumsum(matrix([n for _, n in counts], shards, seed), axis=1)
    plan = spark.createDataFrame(
        [(p, e) for (p, _), e in zip(counts, ends.tolist(), strict=True)], "part int, ends array<long>"
    )
    # Local order, then the shard whose range of the partition's deal holds the rank.
    local = Window.partitionBy("part").orderBy(key(seed, "part", "place"), "place")
    shard = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    sent = rows.withColumn("rank", F.row_number().over(local)).join(plan, "part").withColumn("shard", shard)
    # In the shard: ranges of another random key, their counts added up, places inside.
    mixed = sent.withColumn("mix", key(seed + 1, "part", "place")).withColumn(
        "bucket", F.pmod(F.shiftright("mix", 40), F.lit(buckets))
    )
    mixed = stored(mixed.select("doc_id", "size", "text_crc32", "part", "place", "shard", "mix", "bucket"), "sent")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        mixed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("mix", "part", "place")
    return (
        mixed.withColumn("nth", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            F.col("shard").cast("int"),
            (F.col("offset") + F.col("nth")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
