"""What the operators of this folder share: tables, stored steps, bound expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terralog.sources.shared import shared_path

#: ASCII capitals and their small letters; the contracts lower-case these only.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the cluster's shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks at hand, not the steps before.
    The caller owns that folder and clears it.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once a row.

    An expression that a lambda refers to would be worked out anew for each element.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def small_letters(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def sampled(df: DataFrame, key: str, most: int, among: int) -> DataFrame:
    """At most ``most`` rows of ``df``, those with the smallest hashes of ``key``.

    ``among`` is about how many rows there are.  By it, rows that can hardly be among the
    smallest are left out where they are read, so the top-k that follows sees a few times
    ``most`` rows in all and not ``most`` of each partition.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 32))
    share = 4 * most / max(1, among)
    near = df.where(place < int(share * 2**32)) if share < 1 else df
    return near.orderBy(place, key).limit(most)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; at their end, what the allocators hold unused goes back to the system.

    A Python worker stays for further tasks, of other operators too, beside an executor's
    own memory.
    """
    try:
        yield from batches
    finally:
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()


def per_text(
    docs: DataFrame,
    schema: str,
    start: Callable[[], Callable[[str], Sequence]],
    id_col: str = "doc_id",
    text_col: str = "text",
    end: Callable[[], None] | None = None,
) -> DataFrame:
    """``doc_id`` and the columns of ``schema`` that a function makes of each whole text.

    ``start`` makes the function once a task, and ``end`` is called after its last text.  Ids pass through as they are, null
    included; a null text counts as empty.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        try:
            for b in batches:
                rows = [of(text.as_py()) for text in b.column("text")]
                made = list(zip(*rows, strict=True)) or [[]] * len(types)
                columns = [pa.array(values, f.type) for values, f in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *types.names])
        finally:
            if end:
                end()

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(lambda batches: released(run(batches)), f"doc_id {kind}, {schema}")
