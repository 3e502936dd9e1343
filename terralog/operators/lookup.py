"""Keyed lookups, answered for a whole table of requests at once.

``lookup_first`` works on batch and streaming requests alike.  Each answer row
has ``status`` (200 found, 400 no key given, 404 no match), ``msg`` and the
looked-up columns, which are null unless the status is 200.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog import names as N
from terralog.functions.text import given, message, norm_key
from terralog.names import POS
from terralog.operators.first_match import fetch, first_pos, match_key
from terralog.sources.schemas import REQUESTS


@dataclass(frozen=True)
class Key:
    """Request field ``param`` is compared with dimension column ``column``."""

    param: str
    column: str
    mode: str = "trim_lower"


def request_key(keys: Sequence[Key]) -> Column:
    """The one key a request is looked up by: the last given one of ``keys``.

    A later key wins even when it matches nothing and an earlier one would.
    That makes several keys a single equi-join instead of one join per key.
    """
    choices = [
        F.when(given(F.col(k.param)), match_key(k.param, norm_key(F.col(k.param), k.mode))) for k in reversed(keys)
    ]
    return F.coalesce(*choices)


def keyed_positions(dim: DataFrame, keys: Sequence[Key], pos: str = POS) -> DataFrame:
    """``_by, _value`` and ``pos``: each row's position once per key it answers to."""
    values = [F.struct(F.lit(k.param).alias("_by"), norm_key(F.col(k.column), k.mode).alias("_value")) for k in keys]
    rows = dim.select(F.explode(F.array(*values)).alias("_k"), pos)
    return rows.where(F.col("_k._value").isNotNull()).select("_k.*", pos)


def first_answers(
    dim: DataFrame, keys: Sequence[Key], columns: Sequence[str], into: str = "answer", pos: str = POS
) -> DataFrame:
    """``_key`` and the first row's ``columns``, for every value of every key."""
    firsts = fetch(first_pos(keyed_positions(dim, keys, pos), ["_by", "_value"], pos), dim, columns, into, pos)
    return firsts.select(match_key(F.col("_by"), F.col("_value")).alias("_key"), into)


def request(spark: SparkSession, **fields: str) -> DataFrame:
    """A table of one request: ``request(spark, country="ambria")``."""
    return spark.createDataFrame([{"req_id": 0, **fields}], REQUESTS)


def with_fields(requests: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Requests with all ``fields``; one the table does not have is never given."""
    absent = [f for f in fields if f not in requests.columns]
    return requests.withColumns({f: F.lit(None).cast("string") for f in absent})


def ask(requests: DataFrame, keys: Sequence[Key], keep: Sequence[str]) -> DataFrame:
    """Requests as: ``keep`` columns, struct ``request``, ``_key``."""
    params = [k.param for k in keys]
    return with_fields(requests, params).select(
        *keep, F.struct(*params).alias("request"), request_key(keys).alias("_key")
    )


def answer_with(
    requests: DataFrame,
    answers: DataFrame,
    keys: Sequence[Key],
    found: str,
    missing: str = N.MSG_NEED_COUNTRY_OR_ISO2,
    not_found: str = N.MSG_NO_COUNTRY,
    keep: Sequence[str] = ("req_id",),
) -> DataFrame:
    """Answer every request from a table made by ``first_answers`` with the same keys.

    ``found`` is a template over ``{answer.<column>}`` and ``{request.<param>}``.
    """
    clash = set(keep) & {"status", "msg", *answers.schema["answer"].dataType.names}
    if clash:
        raise ValueError(f"kept request columns clash with answer columns: {sorted(clash)}")
    joined = ask(requests, keys, keep).join(answers, "_key", "left")
    no_key, no_match = F.col("_key").isNull(), F.col("answer").isNull()
    status = F.when(no_key, N.MISSING).when(no_match, N.NOT_FOUND).otherwise(N.OK)
    msg = F.when(no_key, missing).when(no_match, not_found).otherwise(message(found))
    return joined.select(*keep, status.alias("status"), msg.alias("msg"), "answer.*")


def lookup_first(
    requests: DataFrame,
    dim: DataFrame,
    keys: Sequence[Key],
    answer: Sequence[str],
    found: str,
    pos: str = POS,
    **options,
) -> DataFrame:
    """Answer every request with the ``answer`` columns of the first matching row of ``dim``."""
    return answer_with(requests, first_answers(dim, keys, answer, pos=pos), keys, found, **options)


def _by_name_or_iso2(name: str = "name", iso2: str = "iso2") -> list[Key]:
    return [Key("country", name), Key("iso2", iso2)]


def dial_code_of(requests: DataFrame, codes: DataFrame, **options) -> DataFrame:
    """Name or iso2 to ``name, code, dial_code``."""
    return lookup_first(
        requests, codes, _by_name_or_iso2(iso2="code"), ["name", "code", "dial_code"], N.MSG_DIAL_CODE, **options
    )


def position_of(requests: DataFrame, positions: DataFrame, **options) -> DataFrame:
    """Name or iso2 to ``name, iso2, long, lat``."""
    return lookup_first(
        requests, positions, _by_name_or_iso2(), ["name", "iso2", "long", "lat"], N.MSG_POSITION,
        not_found=N.MSG_NO_COUNTRY_POSITION, **options,
    )


def currency_of(requests: DataFrame, currencies: DataFrame, **options) -> DataFrame:
    """Name or iso2 to ``name, currency, iso2, iso3``."""
    return lookup_first(
        requests, currencies, _by_name_or_iso2(), ["name", "currency", "iso2", "iso3"], N.MSG_CURRENCY, **options
    )


def iso_of(requests: DataFrame, iso: DataFrame, **options) -> DataFrame:
    """Name only to ``name, Iso2, Iso3``."""
    return lookup_first(
        requests, iso, [Key("country", "name")], ["name", "Iso2", "Iso3"], N.MSG_ISO,
        missing=N.MSG_NEED_COUNTRY, **options,
    )


def capital_of(requests: DataFrame, capitals: DataFrame, **options) -> DataFrame:
    """Name or iso2 to ``name, capital, iso2, iso3``."""
    return lookup_first(
        requests, capitals, _by_name_or_iso2(), ["name", "capital", "iso2", "iso3"], N.MSG_CAPITAL, **options
    )


def flag_image_of(requests: DataFrame, flags: DataFrame, **options) -> DataFrame:
    """Name or iso2 to ``name, flag, iso2, iso3``."""
    return lookup_first(
        requests, flags, _by_name_or_iso2(), ["name", "flag", "iso2", "iso3"], N.MSG_FLAG, **options
    )


def unicode_flag_of(requests: DataFrame, flags: DataFrame, **options) -> DataFrame:
    """Name or iso2 to ``name, iso2, iso3, unicodeFlag``."""
    return lookup_first(
        requests, flags, _by_name_or_iso2(), ["name", "iso2", "iso3", "unicodeFlag"], N.MSG_UNICODE_FLAG, **options
    )


def states_of(requests: DataFrame, states: DataFrame, **options) -> DataFrame:
    """Name or iso2 to ``name, iso3, iso2, states[]``."""
    return lookup_first(
        requests, states, _by_name_or_iso2(), ["name", "iso3", "iso2", "states"], N.MSG_STATES, **options
    )


def states_answers(requests: DataFrame, states: DataFrame, pos: str = POS, **options) -> DataFrame:
    """Name or iso2 to ``name, iso3, iso2, list_id``, one row per request and no list.

    With ``asked_states`` this answers any number of requests for one country in as many
    rows as there are requests and asked countries; ``states_of`` repeats the list.
    """
    named = states.withColumn("list_id", F.col(pos))
    return lookup_first(
        requests, named, _by_name_or_iso2(), ["name", "iso3", "iso2", "list_id"], N.MSG_STATES, pos=pos, **options
    )


def asked_states(answers: DataFrame, states: DataFrame, pos: str = POS) -> DataFrame:
    """``list_id, states[]`` of the countries in ``answers``, each once."""
    asked = answers.where(F.col("list_id").isNotNull()).select(F.col("list_id").alias("_asked")).distinct()
    lists = states.select(F.col(pos).alias("list_id"), "states")
    return lists.join(asked, F.col("list_id") == F.col("_asked"), "left_semi")


def find_by(requests: DataFrame, dim: DataFrame, param: str, column: str, **options) -> DataFrame:
    """Case-blind, untrimmed lookup on any one column; returns the whole row."""
    answer = [c for c in dim.columns if c != options.get("pos", POS)]
    return lookup_first(
        requests, dim, [Key(param, column, "lower")], answer, found=N.MSG_DEFAULT_OK,
        missing=f"missing param ({param})", **options,
    )
