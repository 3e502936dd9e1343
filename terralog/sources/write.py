"""Writing tables and responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog import names as N
from terralog.operators.series import entities


def write_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write one object per row; JSON leaves null fields out.  ``mode`` says what becomes of an existing path."""
    writer = df.write.mode(mode)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", True)
    writer.format(fmt).save(path)


def write_facts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write long facts and their heads: ``path/facts`` in one folder per year, ``path/heads``.

    A year then reads only its own folder, and what depends on all years, a country's code
    and its place in input order, stands in the heads, a row per country.  Rows are first
    rebalanced by year: small years share a task, a large year is split over several, and
    no task writes a file for every year.
    """
    df.hint("rebalance", "year").write.mode(mode).partitionBy("year").parquet(f"{path}/facts")
    entities(df, "country", ["code"]).write.mode(mode).parquet(f"{path}/heads")


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The facts and heads that ``write_facts`` stored."""
    return spark.read.parquet(f"{path}/facts"), spark.read.parquet(f"{path}/heads")


def write_placed(
    df: DataFrame, table: str, path: str, buckets: int | None = None, pos: str = N.POS, mode: str = "errorifexists"
) -> DataFrame:
    """Store rows at ``path`` as ``table``, in buckets by position and sorted within them; the stored table.

    First matches are fetched by position.  From a table stored so they are fetched without
    moving it: only the winners' positions are shuffled, to its buckets.  Positions are
    unique, so buckets are even.  There are as many as shuffle partitions, if not said;
    with fewer than these, Spark may prefer to shuffle both sides.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(count, pos).write.mode(mode).bucketBy(count, pos).sortBy(pos)
    placed.format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def respond(answers: DataFrame, keep: Sequence[str] = ("req_id",)) -> DataFrame:
    """Lookup answers as ``status, error, msg, data``; ``data`` only when found.

    Absent statuses and texts take the defaults of an error or a success.
    """
    status = F.coalesce(F.col("status"), F.lit(N.INVALID))
    found = status == N.OK
    data = [c for c in answers.columns if c not in (*keep, "status", "msg")]
    return answers.select(
        *keep,
        status.alias("status"),
        (~found).alias("error"),
        F.coalesce("msg", F.when(found, N.MSG_DEFAULT_OK).otherwise(N.MSG_DEFAULT_ERROR)).alias("msg"),
        F.when(found, F.struct(*data)).alias("data"),
    )
