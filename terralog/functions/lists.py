"""Expressions over nested lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def merge_lists(first: Column, second: Column) -> Column:
    """Both lists without repeats; each value stays where it first occurs."""
    return F.array_distinct(
        F.concat(F.coalesce(first, empty_strings()), F.coalesce(second, empty_strings()))
    )


def city_names(cities: Column) -> Column:
    """``array<struct<name>>`` to ``array<string>``; null becomes empty."""
    return F.coalesce(cities["name"], empty_strings())


def flatten_cities(states: Column) -> Column:
    """All city names below a list of states, in order.

    Null inner lists count as empty (``flatten`` alone would return null).
    """
    return city_names(F.flatten(F.filter(states["cities"], lambda c: c.isNotNull())))


def first_where(items: Column, test) -> Column:
    """The first element that passes ``test``, else null."""
    return F.get(F.filter(items, test), F.lit(0))
