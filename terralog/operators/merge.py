"""Merging two member tables (long form of ``functions.lists.merge_lists``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.names import POS


def merge_members(
    first: DataFrame,
    second: DataFrame,
    entity: str,
    item: str,
    exclude_second: Sequence[str] = (),
    pos: str = POS,
) -> DataFrame:
    """Distinct items per entity from two tables, with the place of their first occurrence.

    All of ``first`` precedes all of ``second``.  For the entities named in
    ``exclude_second`` (exact text) the second table is ignored.  Returns
    ``entity, item, source, _pos``.  The distinct is a map-side combined
    aggregate on (entity, item); no list per entity is ever built.
    """
    if exclude_second:
        second = second.where(~F.coalesce(F.col(entity).isin(*exclude_second), F.lit(False)))

    def placed(df: DataFrame, source: int) -> DataFrame:
        at = F.col(pos).cast("long")
        nowhere = F.lit(None).cast("long")
        one, two = (at, nowhere) if source == 1 else (nowhere, at)
        return df.select(entity, item, one.alias("_one"), two.alias("_two"))

    # Two plain minimums aggregate in a hash table; one over a struct would sort.
    merged = (
        placed(first, 1)
        .unionByName(placed(second, 2))
        .groupBy(entity, item)
        .agg(F.min("_one").alias("_one"), F.min("_two").alias("_two"))
    )
    source = F.when(F.col("_one").isNotNull(), 1).otherwise(2)
    return merged.select(entity, item, source.alias("source"), F.coalesce("_one", "_two").alias(pos))
