"""Lookups over a flow of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terralog.names import POS
from terralog.operators.first_match import first_pos
from terralog.operators.lookup import Key, answer_with, first_answers


def stored_answers(dim: DataFrame, keys: Sequence[Key], answer: Sequence[str], path: str, pos: str = POS) -> DataFrame:
    """``first_answers`` worked out once and stored at ``path``, which the caller owns.

    Streams, and batch jobs that ask the same table again, then join a table of known
    size that needs no aggregate: ``answer_with(requests, stored, keys, ...)``.
    """
    answers = first_answers(dim, keys, answer, pos=pos)
    answers.write.parquet(path)
    return dim.sparkSession.read.schema(answers.schema).parquet(path)


def lookup_stream(
    requests: DataFrame,
    dim: DataFrame,
    keys: Sequence[Key],
    answer: Sequence[str],
    found: str,
    pos: str = POS,
    answers: DataFrame | None = None,
    **options,
) -> DataFrame:
    """``lookup_first`` on a streaming request table.

    A stateless stream-static left join, so append mode works and nothing is kept between
    batches.  Nothing runs while the stream is defined: each micro-batch reads the table
    as it then is.  Given ``answers`` from ``stored_answers``, it only joins them.
    """
    if not requests.isStreaming:
        raise ValueError("requests must be a streaming DataFrame")
    if answers is None:
        answers = first_answers(dim, keys, answer, pos=pos)
    return answer_with(requests, answers, keys, found, **options)


def keep_answers(
    rows: DataFrame, keys: Sequence[Key], answer: Sequence[str], path: str, pos: str = POS
) -> DataFrame:
    """``first_answers`` of a dimension that grows, brought up to date from its stream ``rows``.

    Runs over the rows available now that no earlier run has seen.  A micro-batch finds
    the first rows of its own, merges them with the stored answers by least position, and
    stores the result beside them, so the dimension is read once, whatever it grows to.
    Two folders take turns: a batch that is run again reads what it read before.  Returns
    ``_key, answer`` for ``answer_with`` and ``lookup_stream``.  The caller owns ``path``.
    """
    spark = rows.sparkSession
    kept = _kept(rows, keys, answer, pos).schema
    schema = StructType([*kept.fields, StructField("batch", LongType())])

    def slot(number: int) -> str:
        return f"{path}/answers-{number % 2}"

    def merge(batch: DataFrame, number: int) -> None:
        every = _kept(batch, keys, answer, pos)
        if number:
            every = every.unionByName(spark.read.schema(kept).parquet(slot(number - 1)))
        firsts = first_pos(every, ["_key"], "_at", "_first").withColumnRenamed("_key", "_of")
        merged = every.join(firsts, (F.col("_key") == F.col("_of")) & (F.col("_at") == F.col("_first")))
        merged = merged.select("_key", "_at", "answer", F.lit(number).cast("long").alias("batch"))
        merged.write.mode("overwrite").parquet(slot(number))

    query = (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    stored = spark.read.schema(schema).parquet(f"{path}/answers-[01]")
    last = stored.agg(F.max("batch")).first()[0]
    return stored.where(F.col("batch") == F.lit(last)).select("_key", "answer")


def _kept(rows: DataFrame, keys: Sequence[Key], answer: Sequence[str], pos: str) -> DataFrame:
    """``_key, _at, answer`` of the first row of each key among ``rows``."""
    whole = first_answers(rows, keys, [pos, *answer], pos=pos)
    return whole.select("_key", F.col(f"answer.{pos}").alias("_at"), F.struct(*[f"answer.{c}" for c in answer]).alias("answer"))


def land(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all data available now and return what it wrote below ``path``.

    Output and progress log lie there, so a restarted run goes on where the lost one
    stopped.  The caller owns ``path``; on a cluster it must be a shared one.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def land_latest(stream: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregating stream over all data available now; the latest row of each of ``keys``.

    Every micro-batch writes the groups it changed, open ones included, so at the end of
    the input the answer is whole, also for windows that the watermark has not closed.  A
    batch that is run again replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).select(*stream.columns)
