"""Reading tables from files with a fixed schema and a fixed row order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions.numbers import number_of_text
from terralog.functions.text import norm_key
from terralog.names import POS
from terralog.sources import schemas


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "json",
    pos: str | None = None,
    one_document: bool = True,
    check: bool = False,
) -> DataFrame:
    """Read a table and give it ``_pos``, the ordinal that fixes its row order.

    ``pos`` names a unique integer column of the files.  Without one, rows are in the order of
    their file's path and their place in it (see ``file_positions``).  JSON is one array per file, or with
    ``one_document=False`` one object per line, which splits at scale.  Malformed
    input raises, and so does a row without a position; with ``check`` a pass over
    the positions also makes sure that none repeats.
    """
    if pos and pos not in schema.fieldNames():
        schema = T.StructType([T.StructField(pos, T.LongType()), *schema.fields])
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST").option("multiLine", one_document)
    df = reader.load(path)
    if pos:
        at = F.coalesce(F.col(pos).cast("long"), F.raise_error(F.lit(f"a row has no position in {pos}")).cast("long"))
        df = df.select(at.alias(POS), *[c for c in df.columns if c != pos])
        if check and not repeated_positions(df).isEmpty():
            raise ValueError(f"positions in {pos} repeat: first match and stable order need unique ones")
        return df
    return file_positions(df)


#: Rows of a task are numbered in the lower bits, splits of files in the upper.
ROW_BITS = 33


def file_positions(df: DataFrame) -> DataFrame:
    """A table read from files with ``_pos``: files by path, rows by their place in the file.

    A file is read in splits, several to a task, each in order.  The splits, a narrow row
    each, are ranked by path and start; a position is the rank and the row's number in its
    task, so it is unique and in order but leaves gaps.  Rows do not move for it, unless
    there are more splits than a broadcast may hold.
    """
    if len(df.inputFiles()) < 2:
        return df.select(F.monotonically_increasing_id().alias(POS), "*")
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    row = F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)
    numbered = df.select("*", *split, row.alias("_row"))
    ranked = df.select(*split).distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_start")))
    ranks = ranked.select(F.col("_file").alias("_of"), F.col("_start").alias("_from"), F.col("_rank").cast("long").alias("_rank"))
    met = (F.col("_file") == F.col("_of")) & (F.col("_start") == F.col("_from"))
    at = F.shiftleft(F.col("_rank"), ROW_BITS) + F.col("_row")
    return numbered.join(ranks, met).select(at.alias(POS), *df.columns)


def repeated_positions(df: DataFrame, pos: str = POS) -> DataFrame:
    """Positions that are null or not unique, with their row counts; empty for a sound table.

    First match and stable order mean nothing on a table where this is not empty.
    """
    return df.groupBy(pos).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(pos).isNull())


def load_country_population(spark: SparkSession, path: str, one_document: bool = False, **options) -> DataFrame:
    """Long facts ``_pos, country, code, year, value``; one object per line unless told otherwise."""
    raw = load_table(spark, path, schemas.COUNTRY_POPULATION, one_document=one_document, **options)
    return raw.select(
        POS,
        F.col("Country Name").alias("country"),
        F.col("Country Code").alias("code"),
        number_of_text(F.col("Year")).try_cast("int").alias("year"),
        number_of_text(F.col("Value")).alias("value"),
    )


def load_city_population(spark: SparkSession, path: str, one_document: bool = False, **options) -> DataFrame:
    """Long facts ``_pos, city, country, year, value, sex, reliabilty``; see ``load_country_population``."""
    raw = load_table(spark, path, schemas.CITY_POPULATION, one_document=one_document, **options)
    return raw.select(
        POS,
        F.col("City").alias("city"),
        F.col("Country or Area").alias("country"),
        number_of_text(F.col("Year")).try_cast("int").alias("year"),
        number_of_text(F.col("Value")).alias("value"),
        F.col("Sex").alias("sex"),
        F.col("Reliability").alias("reliabilty"),
    )


def with_keys(df: DataFrame, keys: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add stored key columns: ``new=(column, mode)``.

    A comparison with a stored key reaches the file scan; one with
    ``lower(column)`` does not.  Join on stored keys with mode ``exact``.
    """
    return df.withColumns({new: norm_key(F.col(old), mode) for new, (old, mode) in keys.items()})
