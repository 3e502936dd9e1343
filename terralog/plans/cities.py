"""Cities of a country, merged from two sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog import names as N
from terralog.functions.lists import flatten_cities, merge_lists
from terralog.functions.text import message
from terralog.names import POS
from terralog.operators.first_match import match_key
from terralog.operators.lookup import Key, ask, keyed_positions

# Names and codes of both sources, under the request's field names.
SOURCE_KEYS = (Key("country", "country", "lower"), Key("iso2", "iso2"))
# Fixed value: countries, as written in the request, that only use the first source.
FIRST_SOURCE_ONLY = ("Turkey",)


def cities_answers(
    requests: DataFrame,
    cities: DataFrame,
    state_cities: DataFrame,
    exclude_second_source: Sequence[str] = FIRST_SOURCE_ONLY,
    keep: Sequence[str] = ("req_id",),
    pos: str = POS,
) -> DataFrame:
    """Name or iso2 to ``status, msg, list_id``, one row per request and no list.

    ``cities``: ``_pos, iso2, country, cities[]``; ``state_cities``: ``_pos,
    iso2, name, states[{name, cities[{name}]}]``.  Names compare untrimmed, iso2
    codes trimmed.  A country only the second source has is found.

    ``list_id`` holds the positions of the first rows of both sources, null where a source
    has none or may not be seen.  Only names, codes and positions are read; with
    ``asked_city_lists`` any number of requests for one country take as many rows as there
    are requests and asked lists.
    """
    named = state_cities.select(pos, F.col("name").alias("country"), "iso2")
    at, nowhere = F.col(pos).cast("long"), F.lit(None).cast("long")
    ones = keyed_positions(cities, SOURCE_KEYS, pos).select("_by", "_value", at.alias("_one"), nowhere.alias("_two"))
    twos = keyed_positions(named, SOURCE_KEYS, pos).select("_by", "_value", nowhere.alias("_one"), at.alias("_two"))
    firsts = ones.unionByName(twos).groupBy("_by", "_value").agg(F.min("_one").alias("_one"), F.min("_two").alias("_two"))
    # The country's name, by the first source that has it.
    lead = firsts.withColumn("_lead", match_key(F.when(F.col("_one").isNotNull(), "one").otherwise("two"), F.coalesce("_one", "_two")))
    names = cities.select(match_key("one", at).alias("_lead"), "country").unionByName(named.select(match_key("two", at).alias("_lead"), "country"))
    winners = lead.join(names, "_lead").select(
        match_key(F.col("_by"), F.col("_value")).alias("_key"),
        F.struct("country", "_one", "_two").alias("answer"),
    )
    joined = ask(requests, SOURCE_KEYS, keep).join(winners, "_key", "left")
    no_key, nothing = F.col("_key").isNull(), F.col("answer").isNull()
    first_only = F.col("request.country").isin(*exclude_second_source) if exclude_second_source else F.lit(False)
    two = F.when(~F.coalesce(first_only, F.lit(False)), F.col("answer._two"))
    return joined.select(
        *keep,
        F.when(no_key, N.MISSING).when(nothing, N.NOT_FOUND).otherwise(N.OK).alias("status"),
        F.when(no_key, N.MSG_NEED_COUNTRY_OR_ISO2).when(nothing, N.MSG_NO_COUNTRY).otherwise(message(N.MSG_CITIES)).alias("msg"),
        F.when(~nothing, F.struct(F.col("answer._one").alias("one"), two.alias("two"))).alias("list_id"),
    )


def asked_city_lists(answers: DataFrame, cities: DataFrame, state_cities: DataFrame, pos: str = POS) -> DataFrame:
    """``list_id, cities`` of the countries in ``answers``, each pair of first rows merged once, first source first."""
    asked = answers.where(F.col("list_id").isNotNull()).select("list_id").distinct()
    at = F.col(pos).cast("long")
    first = cities.select(at.alias("_one"), F.col("cities").alias("_first"))
    flat = state_cities.select(at.alias("_two"), flatten_cities(F.col("states")).alias("_second"))
    both = asked.join(first, F.col("list_id.one") == F.col("_one"), "left").join(flat, F.col("list_id.two") == F.col("_two"), "left")
    return both.select("list_id", merge_lists(F.col("_first"), F.col("_second")).alias("cities"))


def cities_of(
    requests: DataFrame,
    cities: DataFrame,
    state_cities: DataFrame,
    exclude_second_source: Sequence[str] = FIRST_SOURCE_ONLY,
    keep: Sequence[str] = ("req_id",),
    pos: str = POS,
) -> DataFrame:
    """Name or iso2 to the distinct cities of both sources, repeated for each request; see ``cities_answers``."""
    answers = cities_answers(requests, cities, state_cities, exclude_second_source, keep, pos)
    lists = asked_city_lists(answers, cities, state_cities, pos)

    def key(pair: Column) -> Column:
        return F.when(pair.isNotNull(), F.concat_ws(":", *[F.coalesce(pair[c].cast("string"), F.lit("-")) for c in ("one", "two")]))

    listed = lists.select(key(F.col("list_id")).alias("_pair"), "cities")
    found = answers.withColumn("_pair", key(F.col("list_id"))).join(listed, "_pair", "left")
    return found.select(*keep, "status", "msg", "cities")
