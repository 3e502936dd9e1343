"""Filtered population reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions.args import is_given
from terralog.functions.numbers import number_arg, number_column
from terralog.names import POS
from terralog.operators.filters import drop_leading, name_contains, value_bounds
from terralog.operators.first_match import fetch, match_key
from terralog.operators.order import limit_rows, sort_keys
from terralog.operators.series import CITY_FIELDS, ITEMS_PER_PART, group_key, latest_year, nest_series
from terralog.sources.shared import stored

# Fixed value: a population of -1 means "no figure for this year".
NO_FIGURE = -1


def filter_population(
    facts: DataFrame,
    year: object = None,
    limit: object = None,
    gt: object = None,
    lt: object = None,
    order: str = "asc",
    order_by: str = "population",
    heads: DataFrame | None = None,
) -> DataFrame:
    """Countries with their figure for one year: bounded, ordered, cut.

    ``facts``: ``_pos, country, code, year, value``.  Without ``year`` the latest
    year is used (see ``latest_year``).  A country without a fact for the year,
    or with the figure -1, is left out.  Returns ``country, code, year, value``
    and ``_pos``.

    ``code`` and the place in input order come from a country's first fact of any year.
    Given ``heads`` as ``write_facts`` stores them, they are taken from there, and the year
    filter reaches the scan of the facts; otherwise they take a pass over all years.

    Positions and numbers are aggregated; texts are fetched for the rows that are left, so
    facts with numeric ``year`` and ``value`` are read twice.
    """
    wanted = _year(year) if is_given(year) else latest_year(facts).scalar()
    named = facts.select(POS, group_key("country").alias("country"), "code", "year", "value")
    in_year = number_column(named, "year") == wanted
    number = number_column(named, "value").cast("double")
    numeric = all(isinstance(named.schema[c].dataType, T.NumericType) for c in ("year", "value"))

    def of_year(there: Column) -> list[Column]:
        """The fact of the year: its place and number, and itself where it is no text."""
        fact = [F.min_by(c, there).alias(f"_{c}") for c in ("year", "value")] if numeric else []
        return [F.min(there).alias("_at"), F.min_by(number, there).alias("_number"), *fact]

    if heads is None:
        there = F.when(in_year, F.col(POS))
        picked = named.groupBy("country").agg(F.min(POS).alias("_first"), *of_year(there)).where(F.col("_at").isNotNull())
    else:
        firsts = heads.select(match_key("country", group_key("country")).alias("_key"), F.col(POS).alias("_first"))
        picked = named.where(in_year).groupBy("country").agg(*of_year(F.col(POS)))
        picked = picked.withColumn("_key", match_key("country", F.col("country"))).join(firsts, "_key").drop("_key")
    known = picked.where(~F.col("_number").eqNullSafe(F.lit(float(NO_FIGURE))))
    bounded = value_bounds(known, "_number", gt, lt)
    keys = sort_keys(bounded, order, order_by, "country", "_number", "_first")
    kept = limit_rows(bounded, limit, keys)
    if numeric:
        texts = kept.withColumn("_fact", F.struct(F.col("_year").alias("year"), F.col("_value").alias("value")))
    else:
        texts = fetch(kept, named.where(in_year), ["year", "value"], "_fact", at="_at")
    if heads is None:
        texts = fetch(texts.withColumn(POS, F.col("_first")), named, ["code"], "_head", at="_first")
    else:
        coded = heads.select(POS, "code")
        texts = fetch(texts.withColumn(POS, F.col("_first")), coded, ["code"], "_head", at="_first")
    done = texts.withColumnRenamed(POS, "_first").orderBy(*keys)
    return done.select(F.col("_first").alias(POS), "country", "_head.code", "_fact.year", "_fact.value")


def _year(year: object) -> Column:
    """The year as an integer; one that is no whole number equals no year."""
    number = number_arg(year)
    whole = number is not None and number.is_integer() and abs(number) < 2**31
    return F.lit(int(number) if whole else None).cast("int")


def as_population_counts(rows: DataFrame) -> DataFrame:
    """``year`` and ``value`` as one struct, for writing out."""
    return rows.select("country", "code", F.struct("year", "value").alias("populationCounts"))


def filter_city_population(
    facts: DataFrame,
    limit: object = None,
    order: str = "asc",
    order_by: str = "population",
    country: str | None = None,
    items_per_part: int = ITEMS_PER_PART,
) -> DataFrame:
    """Cities with their series: ordered, filtered by country substring, cut.

    ``facts``: ``_pos, city, country, year, value, sex, reliabilty``.  By
    population means by the first fact's value.  If the first city in order is
    'null' it is dropped.  One row per city and part (see ``nest_series``), in order.

    Ordering and cutting need one row per city, so they run first, on positions and
    numbers aggregated per city and stored, and only the surviving cities' facts are
    nested.  Facts are read twice, and once more by ``country``.
    """
    number = number_column(facts, "value").cast("double")
    heads = (
        facts.select(POS, group_key("city").alias("city"), number.alias("_number"))
        .groupBy("city")
        .agg(F.min(POS).alias(POS), F.min_by("_number", POS).alias("_number"), F.count(F.lit(1)).alias("n"))
    )
    if is_given(country):
        places = facts.select(F.col(POS).alias("_place"), "country")
        heads = name_contains(heads.join(places, F.col(POS) == F.col("_place")).drop("_place"), "country", country)
    heads = stored(heads.drop("country"), "city-heads")
    keys = sort_keys(heads, order, order_by, "city", "_number")
    top = limit_rows(drop_leading(heads.orderBy(*keys), "city", "null"), limit, keys)
    chosen = top.select(match_key("city", F.col("city")).alias("_city"), F.col("_number").alias("_value"))
    members = facts.join(chosen, match_key("city", group_key("city")) == F.col("_city"))
    nested = nest_series(
        members, "city", ["country", "_value"], CITY_FIELDS, items_per_part=items_per_part, sizes=top.select("city", "n")
    )
    return nested.orderBy(*sort_keys(nested, order, order_by, "city", "_value"), "part").drop("_value")
