"""Two-level lookups: a state within a country, then its cities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog import names as N
from terralog.functions.lists import city_names
from terralog.functions.text import given, message, norm_key
from terralog.names import POS
from terralog.operators.first_match import first_by, first_pos, match_key
from terralog.operators.lookup import with_fields


def _answer(country_found: Column, state_found: Column) -> tuple[Column, Column]:
    """Status and message; country is checked before state, absence before a miss."""
    country, state = F.col("request.country"), F.col("request.state")

    def ladder(no_country, no_state, unknown_country, unknown_state, found):
        return (
            F.when(~given(country), no_country)
            .when(~given(state), no_state)
            .when(~country_found, unknown_country)
            .when(~state_found, unknown_state)
            .otherwise(found)
        )

    status = ladder(N.MISSING, N.MISSING, N.NOT_FOUND, N.NOT_FOUND, N.OK)
    msg = ladder(
        N.MSG_NEED_COUNTRY, N.MSG_NEED_STATE, N.MSG_NO_COUNTRY, N.MSG_NO_STATE, message(N.MSG_STATE_CITIES)
    )
    return status.alias("status"), msg.alias("msg")


def _asked(requests: DataFrame, keep: Sequence[str]) -> DataFrame:
    return with_fields(requests, ["country", "state"]).select(
        *keep,
        F.struct("country", "state").alias("request"),
        match_key("country", F.lower("country")).alias("_country"),
        F.lower("state").alias("_state"),
    )


def state_answers(
    requests: DataFrame, state_cities: DataFrame, keep: Sequence[str] = ("req_id",), pos: str = POS
) -> DataFrame:
    """Country and state names to ``status, msg, list_id``, over the nested table, without the lists.

    Requests meet narrow keys only: the country's first row, then the first state of the
    name in it.  ``list_id``: the row's position and the state's place in it.
    """
    named = state_cities.select(pos, F.lower("name").alias("_name"), "states")
    firsts = first_pos(named.where(F.col("_name").isNotNull()), ["_name"], pos, "_row")
    countries = firsts.select(match_key("country", F.col("_name")).alias("_country"), "_row")
    # Only states of rows that a country name leads to are looked at.
    used = named.join(firsts.select(F.col("_row").alias("_used")), F.col(pos) == F.col("_used"), "left_semi")
    inner = used.select(F.col(pos).alias("_row"), F.posexplode("states.name").alias("_nth", "_state"))
    keyed = inner.select("_row", "_nth", norm_key(F.col("_state"), "state").alias("_key"))
    heads = first_pos(keyed.where(F.col("_key").isNotNull()), ["_row", "_key"], "_nth", "_nth")
    states = heads.select(
        match_key("state", F.col("_row"), F.col("_key")).alias("_place"),
        F.struct(F.col("_row").alias("row"), F.col("_nth").alias("nth")).alias("_list"),
    )
    joined = (
        _asked(requests, keep)
        .join(countries, "_country", "left")
        .withColumn("_place", match_key("state", F.col("_row"), F.col("_state")))
        .join(states, "_place", "left")
    )
    status, msg = _answer(F.col("_row").isNotNull(), F.col("_list").isNotNull())
    return joined.select(*keep, status, msg, F.when(status == N.OK, F.col("_list")).alias("list_id"))


def asked_state_cities(answers: DataFrame, state_cities: DataFrame, pos: str = POS) -> DataFrame:
    """``list_id, cities`` of the states in ``answers``, each once; no other state is unfolded."""
    asked = answers.where(F.col("list_id").isNotNull()).select("list_id").distinct()
    wanted = asked.groupBy(F.col("list_id.row").alias("_asked")).agg(F.collect_list("list_id.nth").alias("_nths"))
    rows = state_cities.select(pos, "states").join(wanted, F.col(pos) == F.col("_asked"))
    one = rows.select(F.col(pos).alias("_row"), F.explode("_nths").alias("_nth"), "states")
    row = F.struct(F.col("_row").alias("row"), F.col("_nth").alias("nth"))
    return one.select(row.alias("list_id"), city_names(F.get("states", F.col("_nth"))["cities"]).alias("cities"))


def cities_in_state(
    requests: DataFrame, state_cities: DataFrame, keep: Sequence[str] = ("req_id",), pos: str = POS
) -> DataFrame:
    """Country and state names to the list of city names, repeated for each request.

    Meant for few requests a state; for many, see ``state_answers`` and ``asked_state_cities``.
    """
    answers = state_answers(requests, state_cities, keep, pos)
    lists = asked_state_cities(answers, state_cities, pos)

    def key(row: Column) -> Column:
        return match_key("list", row["row"], row["nth"])

    found = answers.withColumn("_list", key(F.col("list_id")))
    listed = lists.select(key(F.col("list_id")).alias("_list"), "cities")
    return found.join(listed, "_list", "left").select(*keep, "status", "msg", "cities")


def resolve_state(
    requests: DataFrame, countries: DataFrame, states: DataFrame, keep: Sequence[str] = ("req_id",), pos: str = POS
) -> DataFrame:
    """The same lookup over flat tables: ``status``, ``msg``, ``state_id``.

    ``countries``: ``_pos, country_id, name``; ``states``: ``_pos, state_id,
    country_id, name``.
    """
    by_name = first_by(
        countries.select(pos, "country_id", F.lower("name").alias("_name")).where("_name is not null"),
        ["_name"], ["country_id"], into="_in", pos=pos,
    ).select(match_key("country", F.col("_name")).alias("_country"), "_in")
    by_state = first_by(
        states.select(pos, "state_id", "country_id", norm_key(F.col("name"), "state").alias("_name"))
        .where("_name is not null and country_id is not null"),
        ["country_id", "_name"], ["state_id"], into="_hit", pos=pos,
    ).select(match_key("state", F.col("country_id"), F.col("_name")).alias("_place"), "_hit")
    joined = (
        _asked(requests, keep)
        .join(by_name, "_country", "left")
        .withColumn("_place", match_key("state", F.col("_in.country_id"), F.col("_state")))
        .join(by_state, "_place", "left")
    )
    status, msg = _answer(F.col("_in").isNotNull(), F.col("_hit").isNotNull())
    return joined.select(*keep, status, msg, F.when(status == N.OK, F.col("_hit.state_id")).alias("state_id"))


def asked_cities(resolved: DataFrame, cities: DataFrame, pos: str = POS) -> DataFrame:
    """``state_id, _pos, city`` of the states that ``resolve_state`` found for some request, each once.

    With its answers, any number of requests for one state take as many rows as there
    are requests and cities, not one times the other.
    """
    asked = resolved.where(F.col("state_id").isNotNull()).select("state_id").distinct()
    asked = asked.select(match_key("state", F.col("state_id")).alias("_place"))
    rows = cities.select("state_id", pos, "city")
    return rows.join(asked, match_key("state", F.col("state_id")) == F.col("_place"), "left_semi")


def cities_in_state_long(
    requests: DataFrame,
    countries: DataFrame,
    states: DataFrame,
    cities: DataFrame,
    keep: Sequence[str] = ("req_id",),
    pos: str = POS,
) -> DataFrame:
    """Cities of the requested states, one row per city, for city tables of any size.

    ``cities``: ``_pos, state_id, city``.  A request without a city is one row
    with its status and a null city.  Cities meet requests in an inner join, so
    the rows of a state that holds most of the cities can be spread over tasks.
    Meant for few requests a state; for many, see ``asked_cities``.
    """
    resolved = resolve_state(requests, countries, states, keep, pos)
    filled = cities.groupBy("state_id").agg(F.count(F.lit(1)).alias("_n"))
    filled = filled.select(match_key("state", F.col("state_id")).alias("_place"))
    bare = (
        resolved.withColumn("_place", match_key("state", F.col("state_id")))
        .join(filled, "_place", "left_anti")
        .select(*keep, "status", "msg")
    )
    listed = resolved.join(cities, "state_id").select(*keep, "status", "msg", pos, "city")
    return listed.unionByName(bare, allowMissingColumns=True)
