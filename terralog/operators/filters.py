"""Row filters with request-argument rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.functions.args import bounds, is_given
from terralog.functions.numbers import number_arg, number_holds
from terralog.functions.text import contains_ignoring_case
from terralog.names import MSG_NEED_RANGE, POS


def range_filter(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Keep rows with ``low <= column <= high``, read as numbers.

    Nothing is swapped: ``low > high`` keeps no row, nor does a bound that is
    no number.  Text that is no number, and null, are outside every range.
    """
    lo, hi = number_arg(low), number_arg(high)
    if lo is None or hi is None:
        return df.where(F.lit(False))
    return df.where(number_holds(df, column, lambda number: (number >= lo) & (number <= hi)))


def position_range(positions: DataFrame, type: str, min: object, max: object) -> DataFrame:
    """Positions within a range of ``lat`` or ``long``; any other type keeps all."""
    if not (is_given(type) and is_given(min) and is_given(max)):
        raise ValueError(MSG_NEED_RANGE)
    return range_filter(positions, type, min, max) if type in ("lat", "long") else positions


def value_bounds(df: DataFrame, column: str, gt: object = None, lt: object = None) -> DataFrame:
    """Strict bounds, each optional."""
    if not (is_given(gt) or is_given(lt)):
        return df
    return df.where(number_holds(df, column, lambda number: bounds(number, gt, lt)))


def greater_than(df: DataFrame, column: str, gt: object) -> DataFrame:
    return value_bounds(df, column, gt=gt)


def less_than(df: DataFrame, column: str, lt: object) -> DataFrame:
    return value_bounds(df, column, lt=lt)


def within(df: DataFrame, column: str, gt: object, lt: object) -> DataFrame:
    return value_bounds(df, column, gt=gt, lt=lt)


def name_contains(df: DataFrame, column: str, part: str | None) -> DataFrame:
    """Case-blind, untrimmed substring filter; not given means no filter."""
    return df.where(contains_ignoring_case(F.col(column), part)) if is_given(part) else df


def drop_leading(ordered: DataFrame, column: str, value: str, pos: str = POS) -> DataFrame:
    """Remove the first row of an ordered table if its ``column`` is ``value``.

    The head is a top-1; the rest is a filter by its ``pos``, a scalar.  Both read
    ``ordered``, so store what is dear to compute.  The result is unordered.
    """
    head = ordered.limit(1).where(F.col(column) == value).select(pos).scalar()
    return ordered.where(~F.col(pos).eqNullSafe(head))
