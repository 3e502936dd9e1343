"""Stable sorting, limits and sampling.

Every sort ends in ``_pos``, so ties keep input order in both directions and
the range partitioning of a global sort can split a value that most rows share.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.functions.args import parse_limit
from terralog.functions.numbers import number_column
from terralog.functions.text import BLANKS
from terralog.names import POS
from terralog.sources.shared import stored


def sort_keys(
    df: DataFrame, order: str, order_by: str, name: str, value: str, pos: str = POS
) -> list[Column]:
    """Sort keys for ``order`` ('asc'/'dsc') and ``order_by`` ('name' or else the value).

    By name the direction is matched exactly, and any other word leaves input
    order.  By value ``dsc`` may have blanks and capitals, and every other word
    means ascending.  Values that are no numbers come last.
    """
    if order_by.strip(BLANKS).lower() == "name":
        key = F.upper(F.col(name))
        first = {"asc": [key.asc_nulls_last()], "dsc": [key.desc_nulls_last()]}.get(order, [])
    else:
        key = number_column(df, value)
        descending = order.strip(BLANKS).lower() == "dsc"
        first = [key.desc_nulls_last() if descending else key.asc_nulls_last()]
    return [*first, F.col(pos).asc()]


def order_rows(
    df: DataFrame,
    order: str = "asc",
    order_by: str = "population",
    name: str = "country",
    value: str = "value",
    pos: str = POS,
    limit: object = None,
) -> DataFrame:
    """The rows in order, all of them or the first ``limit``."""
    return limit_rows(df, limit, sort_keys(df, order, order_by, name, value, pos))


#: Up to this limit the rows kept are merged in one place (a top-k).
TOP_K = 10_000


def limit_rows(df: DataFrame, limit: object, keys: Sequence[Column], top_k: int | None = None) -> DataFrame:
    """The first ``limit`` rows in the order of ``keys``, ordered; see ``parse_limit``.

    A limit up to ``top_k`` (``TOP_K`` by default) is a top-k, and nothing runs here.  A larger one is found by
    rank: the rows are cut into as many ranges of the order as there are shuffle partitions
    and stored, and a count per range tells which are in; only the range that the cut goes
    through is cut again, until what is left of the limit is a top-k.  Those jobs run at
    once.  The driver sees a row per range, whatever the table's size, and no task sees
    more than a range.
    """
    n = parse_limit(limit)
    top_k = TOP_K if top_k is None else top_k
    if n is None:
        return df.orderBy(*keys)
    if n <= top_k:
        return df.orderBy(*keys).limit(n)
    kept: list[DataFrame] = []
    rows, size = df, None
    while True:
        ranges = stored(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
        counts = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
        before, cut, inside = 0, None, 0
        for number, count in counts:
            if before + count > n:
                cut, inside = number, count
                break
            before += count
        full = ranges if cut is None else ranges.where(F.col("_range") < cut)
        kept.append(full.drop("_range"))
        n -= before
        if cut is None or n == 0:
            break
        rows = ranges.where(F.col("_range") == cut).drop("_range")
        if n <= top_k or inside == size:  # rows that the keys do not tell apart cannot be cut
            kept.append(rows.orderBy(*keys).limit(n))
            break
        size = inside
    return reduce(DataFrame.unionByName, kept).orderBy(*keys)


def capitals_in_order(capitals: DataFrame) -> DataFrame:
    return order_rows(capitals, "asc", "name", name="name")


def sample_rows(df: DataFrame, n: int = 1, seed: int | None = None, pos: str | None = None) -> DataFrame:
    """``n`` rows drawn uniformly, whole rows.

    With ``seed`` and a unique column ``pos`` the draw depends on the data only, not on
    how it is partitioned, so a lost task recomputes the same draw: rows are taken in the
    order of ``md5`` of ``seed:pos``.
    """
    if pos is None or seed is None:
        return limit_rows(df.withColumn("_draw", F.rand(seed)), n, [F.col("_draw").asc()]).drop("_draw")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(pos).cast("string")).cast("binary"))
    return limit_rows(df, n, [draw.asc(), F.col(pos).asc()])
