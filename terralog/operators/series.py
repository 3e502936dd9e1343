"""Yearly series: long facts in, one series per entity out.

Long facts hold one row per entity and year.  They are the form to compute on;
a nested series is a view for reading, built last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralog import names as N
from terralog.names import POS
from terralog.operators.first_match import fetch, first_pos, match_key
from terralog.operators.lookup import Key, lookup_first
from terralog.sources.shared import stored

# A series comes in parts of this many items.
ITEMS_PER_PART = 100_000
# Item fields of a series (one is misspelt in the data).
COUNTRY_FIELDS = {"year": "year", "value": "value"}
CITY_FIELDS = {"year": "year", "value": "value", "sex": "sex", "reliabilty": "reliabilty"}


def group_key(name: str) -> Column:
    """Entity names group as text, so an absent name is the entity 'null'."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def entities(facts: DataFrame, name: str, carry: Sequence[str], pos: str = POS) -> DataFrame:
    """One row per entity: name, first row's ``carry``, ``pos`` of the first row."""
    named = facts.select(group_key(name).alias("_name"), pos, *carry)
    firsts = first_pos(named, ["_name"], pos)
    return fetch(firsts.withColumn(pos, F.col("_at")), named, [F.lit(1), *carry], "_carry", pos).select(
        F.col("_name").alias(name), *[f"_carry.{c}" for c in carry], pos
    )


def with_ordinals(rows: DataFrame, name: str, at: str, into: str = "_idx") -> DataFrame:
    """Rows with their place, from 0, among those of the same ``name`` in the order of ``at``.

    The rows are cut into ranges of ``(name, at)``, sorted within them and stored, numbered
    as they are written.  A row per range and name then tells how many come before it, so
    rows move once, whatever share of them one name has; the only window holds a row per
    range.
    """
    ranged = rows.repartitionByRange(name, at).sortWithinPartitions(name, at)
    # The number of a row: its range in the upper bits, its place in the range in the lower 33.
    numbered = stored(ranged.withColumn("_number", F.monotonically_increasing_id()), "ordinals")
    numbered = numbered.withColumn("_range", F.shiftright("_number", 33))
    runs = numbered.groupBy("_range", name).agg(F.count(F.lit(1)).alias("_n"), F.min("_number").alias("_start"))
    earlier = Window.partitionBy(name).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift")
    placed = numbered.join(runs.select("_range", name, shift), ["_range", name])
    return placed.withColumn(into, F.col("_shift") + F.col("_number")).drop("_range", "_number", "_shift")


def nest_series(
    facts: DataFrame,
    name: str,
    carry: Sequence[str],
    fields: Mapping[str, str],
    into: str = "populationCounts",
    items_per_part: int | None = ITEMS_PER_PART,
    pos: str = POS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Group facts by ``name`` and nest ``fields`` in ``_pos`` order.

    Returns ``name``, the first row's ``carry``, ``_pos`` of the first row, ``part``,
    ``offset`` and the list ``into``.  An entity comes in parts 0, 1, ... of
    ``items_per_part`` items, the last with what is left; ``offset`` counts the items
    before a part.  Most entities have one part and are nested in one shuffle.  Those with
    more items are counted first; their facts get ordinals (``with_ordinals``) and each part is
    built by itself, so no task holds an unbounded list, whatever share of the facts one
    entity has.  Parts depend on the entity's own items alone.

    ``sizes`` (``name, n``) saves the count where it is known.  ``items_per_part=None``
    counts nothing and gives one part; use it only where the facts bound the length, such
    as totals grouped by entity and year.
    """
    items = facts.select(
        group_key(name).alias("_name"),
        F.col(pos).cast("long").alias("_at"),
        F.struct(F.lit(1).alias("_1"), *carry).alias("_carry"),
        *[F.col(old).alias(f"_f{k}") for k, old in enumerate(fields.values())],
    )
    item = F.struct("_at", *[F.col(f"_f{k}").alias(new) for k, new in enumerate(fields)])
    zero = F.lit(0).cast("long")

    def nested(rows: DataFrame, *keys: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(item)).alias("_items")
        # The first row's texts come along in the same pass; lists are aggregated as objects anyway.
        return rows.groupBy(*keys).agg(listed, F.min_by("_carry", "_at").alias("_carry"), F.min("_at").alias("_first"))

    def whole(rows: DataFrame) -> DataFrame:
        return nested(rows, "_name").withColumns({"part": zero, "offset": zero})

    long = None
    if items_per_part is not None:
        if sizes is None:
            sizes = items.groupBy("_name").agg(F.count(F.lit(1)).alias("n"))
        else:
            sizes = sizes.select(F.col(name).alias("_name"), "n")
        long = stored(sizes.where(F.col("n") > int(items_per_part)).select(match_key("entity", F.col("_name")).alias("_long")), "long")
    if long is None or long.isEmpty():
        parts = whole(items)
    else:
        is_long = match_key("entity", F.col("_name")) == F.col("_long")
        placed = with_ordinals(items.join(long, is_long, "left_semi"), "_name", "_at")
        cut = nested(placed.withColumn("part", F.expr(f"_idx div {int(items_per_part)}")), "_name", "part")
        firsts = placed.where(F.col("_idx") == 0)
        heads = firsts.select(match_key("entity", F.col("_name")).alias("_long"), "_carry", F.col("_at").alias("_first"))
        cut = cut.drop("_carry", "_first").join(heads, is_long).drop("_long")
        cut = cut.withColumn("offset", F.col("part") * int(items_per_part))
        parts = whole(items.join(long, is_long, "left_anti")).unionByName(cut)
    bare = F.transform("_items", lambda i: F.struct(*[i[f].alias(f) for f in fields]))
    return parts.select(
        F.col("_name").alias(name),
        *[f"_carry.{c}" for c in carry],
        F.col("_first").alias(pos),
        "part",
        "offset",
        bare.alias(into),
    )


def country_series(facts: DataFrame, items_per_part: int | None = ITEMS_PER_PART) -> DataFrame:
    """``country, code, iso3, populationCounts[{year, value}]`` per country."""
    nested = nest_series(facts, "country", ["code"], COUNTRY_FIELDS, items_per_part=items_per_part)
    return nested.withColumn("iso3", F.col("code"))


def city_series(facts: DataFrame, items_per_part: int | None = ITEMS_PER_PART) -> DataFrame:
    """``city, country, populationCounts[{year, value, sex, reliabilty}]`` per city name.

    Grouped by the name alone: same-named cities merge under the first's country.
    """
    return nest_series(facts, "city", ["country"], CITY_FIELDS, items_per_part=items_per_part)


def unnest_series(nested: DataFrame, into: str = "populationCounts") -> DataFrame:
    """One row per item; ``idx`` is its place in the whole series, across parts."""
    kept = [c for c in nested.columns if c not in ("part", "offset", into)]
    return nested.select(*kept, "offset", F.posexplode(into).alias("_idx", "_item")).select(
        *kept, (F.col("offset") + F.col("_idx")).alias("idx"), "_item.*"
    )


def latest_year(facts: DataFrame, name: str = "country", pos: str = POS) -> DataFrame:
    """One row, ``year``: that of the last fact of the first entity.

    This is not the greatest year; see ``greatest_year``.  One pass: the first position
    and the last year of each entity, then the year of the least position.
    """
    ends = facts.groupBy(group_key(name).alias("_name")).agg(F.min(pos).alias("_first"), F.max_by("year", pos).alias("year"))
    return ends.agg(F.min_by("year", "_first").alias("year"))


def greatest_year(facts: DataFrame) -> DataFrame:
    return facts.agg(F.max("year").alias("year"))


def _answers(
    requests: DataFrame,
    facts: DataFrame,
    name: str,
    carry: Sequence[str],
    keys: Sequence[Key],
    found: str,
    missing: str,
    not_found: str,
    keep: Sequence[str],
    pos: str,
) -> DataFrame:
    heads = entities(facts, name, carry, pos)
    return lookup_first(requests, heads, keys, [name, *carry], found, pos, missing=missing, not_found=not_found, keep=keep)


def _asked_facts(answers: DataFrame, facts: DataFrame, name: str, fields: Sequence[str], pos: str) -> DataFrame:
    """The facts of the entities that some request found, each once."""
    asked = answers.where(F.col("status") == N.OK).select(name).distinct().select(match_key(name, F.col(name)).alias("_entity"))
    rows = facts.select(group_key(name).alias(name), pos, *fields)
    return rows.join(asked, match_key(name, F.col(name)) == F.col("_entity"), "left_semi")


def _spread(answers: DataFrame, facts: DataFrame, name: str, fields: Sequence[str], pos: str) -> DataFrame:
    """Each answer with all facts of its entity, one row per fact."""
    named = answers.withColumn("_entity", F.when(F.col("status") == N.OK, match_key(name, F.col(name))))
    rows = facts.select(match_key(name, group_key(name)).alias("_entity"), pos, *fields)
    failed = answers.where(F.col("status") != N.OK)
    return named.join(rows, "_entity").drop("_entity").unionByName(failed, allowMissingColumns=True)


COUNTRY_KEYS = (Key("country", "country"), Key("iso3", "code"))
COUNTRY_TEXTS = (N.MSG_COUNTRY_POPULATION, N.MSG_NEED_COUNTRY_OR_ISO3, N.MSG_NO_COUNTRY_DATA)
CITY_KEYS = (Key("city", "city"),)
CITY_TEXTS = (N.MSG_CITY_POPULATION, N.MSG_NEED_CITY, N.MSG_NO_CITY_DATA)


def country_answers(
    requests: DataFrame, facts: DataFrame, keep: Sequence[str] = ("req_id",), pos: str = POS
) -> DataFrame:
    """Name or iso3 to ``status, msg, country, code``, one row per request.

    With ``asked_country_facts`` this answers any number of requests for one country in
    as many rows as there are requests and facts, not one times the other.
    """
    return _answers(requests, facts, "country", ["code"], COUNTRY_KEYS, *COUNTRY_TEXTS, keep, pos)


def asked_country_facts(answers: DataFrame, facts: DataFrame, pos: str = POS) -> DataFrame:
    """``country, _pos, year, value`` of the countries in ``answers``, each country once."""
    return _asked_facts(answers, facts, "country", ["year", "value"], pos)


def city_answers(
    requests: DataFrame, facts: DataFrame, keep: Sequence[str] = ("req_id",), pos: str = POS
) -> DataFrame:
    """City name to ``status, msg, city, country``, one row per request; see ``country_answers``."""
    return _answers(requests, facts, "city", ["country"], CITY_KEYS, *CITY_TEXTS, keep, pos)


def asked_city_facts(answers: DataFrame, facts: DataFrame, pos: str = POS) -> DataFrame:
    """``city, _pos, year, value, sex, reliabilty`` of the cities in ``answers``, each city once."""
    return _asked_facts(answers, facts, "city", ["year", "value", "sex", "reliabilty"], pos)


def population_of_country(
    requests: DataFrame, facts: DataFrame, keep: Sequence[str] = ("req_id",), pos: str = POS
) -> DataFrame:
    """Name or iso3 to the country's facts, one row per request and fact in ``_pos`` order.

    A request that finds nothing is one row with its status and null facts.  Meant for
    few requests; many for the same countries are better answered by
    ``country_answers`` and ``asked_country_facts``.
    """
    return _spread(country_answers(requests, facts, keep, pos), facts, "country", ["year", "value"], pos)


def population_of_city(
    requests: DataFrame, facts: DataFrame, keep: Sequence[str] = ("req_id",), pos: str = POS
) -> DataFrame:
    """City name to the city's facts, one row per request and fact; see ``population_of_country``."""
    fields = ["year", "value", "sex", "reliabilty"]
    return _spread(city_answers(requests, facts, keep, pos), facts, "city", fields, pos)
