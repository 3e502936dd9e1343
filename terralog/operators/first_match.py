"""First match: of several rows with one key, the one with the lowest ``_pos``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.text import norm_key
from terralog.names import POS


def first_pos(df: DataFrame, keys: Sequence[str], pos: str = POS, into: str = "_at") -> DataFrame:
    """One row per key: ``keys`` and the lowest ``pos``.

    A minimum of a number combines on the map side in a hash table, so a key that holds
    most of the rows sends one row per input partition through the shuffle.
    """
    return df.groupBy(*keys).agg(F.min(pos).alias(into))


def fetch(firsts: DataFrame, rows: DataFrame, columns: Sequence[str], into: str, pos: str = POS, at: str = "_at") -> DataFrame:
    """Replace position ``at`` by a struct ``into`` of the ``columns`` of the row at that place."""
    placed = rows.select(F.col(pos).alias("_place"), F.struct(*columns).alias(into))
    return firsts.join(placed, F.col(at) == F.col("_place")).drop(at, "_place")


def first_by(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], into: str = "answer", pos: str = POS
) -> DataFrame:
    """One row per key: ``keys`` and a struct ``into`` of the first row's columns.

    Only positions are aggregated; texts and lists are fetched for the winners, by one
    join on the position.
    """
    return fetch(first_pos(df, keys, pos), df, columns, into, pos)


def match_key(tag: str | Column, *values: Column) -> Column:
    """``tag:value`` as the one text column to join first matches on; null if a value is.

    Both sides of a join build it after their last aggregate.  The join then has
    a shuffle of its own on each side, and only between two such shuffles does
    Spark split a key that most of the left rows share.  (A join that reuses the
    aggregate's partitioning would leave that key to one task.)  Of several
    values, all but the last carry their length, so no two lists look alike.
    """
    parts = [F.lit(tag) if isinstance(tag, str) else tag]
    *leading, last = [value.cast("string") for value in values]
    for value in leading:
        parts += [F.lit(":"), F.length(value).cast("string"), F.lit(":"), value]
    return F.concat(*parts, F.lit(":"), last)


def enrich_first(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    add: Mapping[str, str],
    mode: str = "trim_lower",
    pos: str = POS,
) -> DataFrame:
    """Left outer join with the first match; never fans out, never drops.

    ``add`` maps new column names to columns of ``right``.  A column that
    ``left`` already has is left alone, null or not.  Null keys do not match.
    Spark picks the join by the size it sees: broadcast for a small right side,
    sort-merge with skew splitting of the left side otherwise.
    """
    missing = {new: old for new, old in add.items() if new not in left.columns}
    if not missing:
        return left
    keyed = right.select(
        norm_key(F.col(right_key), mode).alias("_value"),
        F.col(pos).alias("_first"),
        *[F.col(old).alias(new) for new, old in missing.items()],
    ).where(F.col("_value").isNotNull())
    matches = first_by(keyed, ["_value"], list(missing), into="_match", pos="_first")
    return (
        left.withColumn("_key", match_key(left_key, norm_key(F.col(left_key), mode)))
        .join(matches.select(match_key(left_key, F.col("_value")).alias("_key"), "_match"), "_key", "left")
        .select(*[F.col(c) for c in left.columns], *[F.col(f"_match.{c}").alias(c) for c in missing])
    )
