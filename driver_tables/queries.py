"""One query per operator: ``name -> function(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driver_tables import roles as R
from terralog.functions.args import bounds
from terralog.functions.lists import flatten_cities
from terralog.functions.lists import merge_lists as merge_columns
from terralog.functions.numbers import number_of_text
from terralog.names import MSG_DIAL_CODE, POS
from terralog.operators import filters, hierarchy, lookup, merge, order, project, series
from terralog.operators.first_match import enrich_first
from terralog.operators.lookup import Key, answer_with
from terralog.plans.cities import asked_city_lists as run_asked_city_lists
from terralog.plans.cities import cities_answers as run_cities_answers
from terralog.plans.cities import cities_of as run_cities_of
from terralog.plans.info import country_info as run_country_info
from terralog.plans.population import as_population_counts
from terralog.plans.population import filter_city_population as run_filter_city_population
from terralog.plans.population import filter_population as run_filter_population
from terralog.sources import schemas
from terralog.sources.load import load_city_population, load_country_population, load_table, with_keys
from terralog.sources.shared import shared_path
from terralog.sources.write import read_facts, respond, write_facts, write_placed, write_result
from terralog.streaming.lookups import keep_answers, land, land_latest
from terralog.streaming.lookups import lookup_stream as run_lookup_stream
from terralog.streaming.rate import rate_breaches as run_rate_breaches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def digest(items: Column) -> Column:
    """A fingerprint of a whole list of texts, in order."""
    return F.md5(F.array_join(items, "|").cast("binary"))


def plain(df: DataFrame) -> DataFrame:
    """``_pos`` under a name without the underscore."""
    return df.withColumnRenamed(POS, "pos")


# -- full-table views ---------------------------------------------------------


@query
def project_positions(spark, sf):
    return plain(project.positions(R.codes(spark, sf)))


@query
def project_codes(spark, sf):
    return plain(project.dial_codes(R.codes(spark, sf)))


@query
def project_currency(spark, sf):
    return plain(project.currencies(R.master(spark, sf)))


@query
def project_unicode_flags(spark, sf):
    return plain(project.unicode_flags(R.master(spark, sf)))


@query
def project_flag_images(spark, sf):
    return plain(project.flag_images(R.flags(spark, sf), R.master(spark, sf)))


@query
def project_iso(spark, sf):
    iso = project.iso_codes(R.flags(spark, sf), R.master(spark, sf))
    return iso.select(F.col(POS).alias("pos"), "name", F.col("Iso2").alias("iso_a2"), F.col("Iso3").alias("iso_a3"))


@query
def project_rename(spark, sf):
    nation = R.table(spark, sf, "nation").withColumnRenamed("n_nationkey", POS)
    supplier = R.table(spark, sf, "supplier").withColumnRenamed("s_suppkey", POS)
    named = project.project(nation, name="n_name", code="n_regionkey")
    return plain(
        project.project(supplier, name="s_name", code="s_nationkey").unionByName(named.withColumn(POS, -F.col(POS) - 1))
    )


@query
def project_countries_and_cities(spark, sf):
    rich = project.countries_and_cities(R.doc_cities(spark, sf), R.doc_master(spark, sf))
    return rich.select(
        F.col(POS).alias("pos"), "country", "iso2", "iso3",
        F.size("cities").alias("n_cities"), digest(F.col("cities")).alias("cities_md5"),
    )


@query
def nested_projection(spark, sf):
    slim = project.country_states(R.doc_states(spark, sf))
    return slim.select("name", "iso2", "iso3", F.posexplode("states").alias("idx", "s")).select(
        "name", "iso2", "iso3", "idx", F.md5(F.col("s.name").cast("binary")).alias("state_md5"), "s.state_code"
    )


@query
def project_state_cities(spark, sf):
    nested = project.state_cities(R.doc_state_cities(spark, sf))
    words = flatten_cities(F.col("states"))
    return nested.select(
        F.col(POS).alias("pos"), "name", "iso2", "iso3",
        F.size("states").alias("n_states"), F.size(words).alias("n_cities"), digest(words).alias("cities_md5"),
    )


@query
def country_series(spark, sf):
    nested = series.country_series(R.order_facts(spark, sf))
    return series.unnest_series(nested).select("country", "code", "iso3", "idx", "year", "value")


@query
def country_series_totals(spark, sf):
    # One fact per nation and year, so a series is never longer than the years.
    nested = series.country_series(R.nation_facts(spark, sf), items_per_part=None)
    return series.unnest_series(nested).select("country", "code", "iso3", "idx", "year", "value")


@query
def city_series_homonyms(spark, sf):
    nested = series.city_series(R.part_city_facts(spark, sf))
    return series.unnest_series(nested).select("city", "country", "idx", "year", "value", "sex", "reliabilty")


@query
def city_series_in_parts(spark, sf):
    """The same series in many parts: the way a very long series is built."""
    nested = series.city_series(R.part_city_facts(spark, sf), items_per_part=8)
    return series.unnest_series(nested).select("city", "country", "idx", "year", "value", "sex", "reliabilty")


# -- first-match joins --------------------------------------------------------


@query
def enrich_first_match(spark, sf):
    left = R.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit(" nation_"), (F.col("c_custkey") % 30).cast("string"), F.lit(" ")).alias("country")
    )
    nation = R.table(spark, sf, "nation").withColumnRenamed("n_nationkey", POS)
    return enrich_first(left, nation, "country", "n_name", {"nationkey": POS, "regionkey": "n_regionkey"})


@query
def enrich_duplicate_keys(spark, sf):
    left = R.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t")).alias("name")
    )
    added = {"iso2": "Iso2", "iso3": "Iso3"}
    return enrich_first(left, R.part_master(spark, sf), "name", "Name", added).select("p_partkey", "iso2", "iso3")


@query
def enrich_from_placed(spark, sf):
    """First matches fetched from a table that is stored by position."""
    left = R.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t")).alias("name")
    )
    name = f"master_{uuid.uuid4().hex}"
    master = write_placed(R.part_master(spark, sf), name, shared_path(spark, name))
    added = {"iso2": "Iso2", "iso3": "Iso3"}
    return enrich_first(left, master, "name", "Name", added).select("p_partkey", "iso2", "iso3")


@query
def enrich_keeps_existing(spark, sf):
    """A column the left side has already, here often null, is not replaced."""
    left = R.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("iso2")
    )
    added = {"iso2": "Iso2", "iso3": "Iso3"}
    return enrich_first(left, R.part_master(spark, sf), "name", "Name", added).select("p_partkey", "iso2", "iso3")


@query
def enrich_stored_keys(spark, sf):
    """Keys prepared at ingest and joined as they are."""
    left = with_keys(
        R.table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("name")),
        {"k": ("name", "trim_lower")},
    )
    right = with_keys(R.part_master(spark, sf), {"k_name": ("Name", "trim_lower")})
    return enrich_first(left, right, "k", "k_name", {"iso2": "Iso2"}, mode="exact").select("p_partkey", "iso2")


# -- lookups ------------------------------------------------------------------


@query
def lookup_dial_code(spark, sf):
    return lookup.dial_code_of(R.requests(spark, sf), project.dial_codes(R.codes(spark, sf)))


@query
def lookup_position(spark, sf):
    return lookup.position_of(R.requests(spark, sf), project.positions(R.codes(spark, sf)))


@query
def lookup_currency(spark, sf):
    return lookup.currency_of(R.requests(spark, sf), project.currencies(R.master(spark, sf)))


@query
def lookup_iso(spark, sf):
    iso = project.iso_codes(R.flags(spark, sf), R.master(spark, sf))
    found = lookup.iso_of(R.requests(spark, sf), iso)
    return found.select(
        "req_id", "status", "msg", "name", F.col("Iso2").alias("iso_a2"), F.col("Iso3").alias("iso_a3")
    )


@query
def lookup_capital(spark, sf):
    return lookup.capital_of(R.requests(spark, sf), project.capitals(R.master(spark, sf)))


@query
def lookup_flag_image(spark, sf):
    return lookup.flag_image_of(
        R.requests(spark, sf), project.flag_images(R.flags(spark, sf), R.master(spark, sf))
    )


@query
def lookup_unicode_flag(spark, sf):
    return lookup.unicode_flag_of(R.requests(spark, sf), project.unicode_flags(R.master(spark, sf)))


@query
def lookup_states(spark, sf):
    found = lookup.states_of(R.doc_requests(spark, sf), project.country_states(R.doc_states(spark, sf)))
    names = F.transform("states", lambda s: F.concat_ws(":", s["state_code"], s["name"]))
    return found.select(
        "req_id", "status", "msg", "name", "iso2", "iso3",
        F.when(F.col("status") == 200, F.size("states")).alias("n_states"), digest(names).alias("states_md5"),
    )


@query
def lookup_population(spark, sf):
    return plain(series.population_of_country(R.series_requests(spark, sf), R.order_facts(spark, sf)))


@query
def lookup_city_population(spark, sf):
    return plain(series.population_of_city(R.series_requests(spark, sf), R.order_city_facts(spark, sf)))


def _hot_requests(spark, sf):
    """Every order asks for one of six customers or for none, so each is asked for many times."""
    kind = F.col("o_custkey") % 7
    return R.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("req_id"), F.when(kind < 6, F.upper(R.customer_name(kind + 1))).alias("country")
    )


@query
def lookup_population_answers(spark, sf):
    """Requests that ask one country many times: one row each, without its facts."""
    return series.country_answers(_hot_requests(spark, sf), R.order_facts(spark, sf))


@query
def lookup_population_facts(spark, sf):
    """The facts of the countries that some request asked for, each once."""
    facts = R.order_facts(spark, sf)
    return plain(series.asked_country_facts(series.country_answers(_hot_requests(spark, sf), facts), facts))


def _hot_cities(spark, sf):
    """Every part asks for one of five city names, for none or for an unknown one."""
    kind = F.col("p_partkey") % 7
    some = R.table(spark, sf, "part").where(F.col("p_partkey") <= 5).select(F.col("p_partkey").alias("nth"), F.upper("p_name").alias("city"))
    asked = R.table(spark, sf, "part").select(F.col("p_partkey").alias("req_id"), kind.alias("nth"))
    return asked.join(some, "nth", "left").select("req_id", F.when(F.col("nth") == 6, "nowhere").otherwise(F.col("city")).alias("city"))


@query
def lookup_city_answers(spark, sf):
    """Requests that ask one city many times: one row each, without its facts."""
    return series.city_answers(_hot_cities(spark, sf), R.part_city_facts(spark, sf))


@query
def lookup_city_facts(spark, sf):
    """The facts of the cities that some request asked for, each once."""
    facts = R.part_city_facts(spark, sf)
    return plain(series.asked_city_facts(series.city_answers(_hot_cities(spark, sf), facts), facts))


@query
def lookup_any_column(spark, sf):
    asked = R.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("req_id"),
        F.when(F.col("o_orderstatus") == "F", R.customer_name("o_custkey"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.upper(R.customer_name("o_custkey")), F.lit(" ")))
        .otherwise(F.upper(R.customer_name("o_custkey")))
        .alias("country"),
    )
    codes = R.codes(spark, sf).select(POS, "name", "dial_code")
    return lookup.find_by(asked, codes, "country", "name")


@query
def lookup_status(spark, sf):
    """How often each status occurs, over all requests of one kind."""
    return lookup_dial_code(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def lookup_duplicate_names(spark, sf):
    """Requests on names that many rows share: the first row answers."""
    asked = R.table(spark, sf, "part").select(
        F.col("p_partkey").alias("req_id"),
        F.upper("p_name").alias("country"),
        F.when(F.col("p_size") <= 10, F.concat(F.lit("p-"), F.col("p_partkey").cast("string"))).alias("iso2"),
    )
    return lookup.lookup_first(
        asked, R.part_master(spark, sf), [Key("country", "Name"), Key("iso2", "Iso2")], ["Iso2", "Iso3"], "{answer.Iso2} found"
    ).select("req_id", "status", "msg", F.col("Iso2").alias("iso_a2"), F.col("Iso3").alias("iso_a3"))


@query
def lookup_two_level(spark, sf):
    region = R.table(spark, sf, "region").select(
        F.col("r_regionkey").alias(POS), F.col("r_regionkey").alias("country_id"), F.col("r_name").alias("name")
    )
    nation = R.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias(POS), F.col("n_nationkey").alias("state_id"),
        F.col("n_regionkey").alias("country_id"), F.col("n_name").alias("name"),
    )
    customer = R.table(spark, sf, "customer").select(
        F.col("c_custkey").alias(POS), F.col("c_nationkey").alias("state_id"), F.col("c_name").alias("city")
    )
    return plain(hierarchy.cities_in_state_long(R.place_requests(spark, sf), region, nation, customer))


def _repeated_places(spark, sf):
    """Countries and states whose names many rows share, and requests for them."""
    customer, orders = R.table(spark, sf, "customer"), R.table(spark, sf, "orders")
    key, order_key = F.col("c_custkey"), F.col("o_orderkey")
    countries = customer.select(key.alias(POS), key.alias("country_id"), F.col("c_mktsegment").alias("name"))
    states = orders.select(
        order_key.alias(POS), order_key.alias("state_id"), F.col("o_custkey").alias("country_id"), F.col("o_orderpriority").alias("name")
    )
    words = F.array(*[F.lit(x) for x in ("1-urgent", "2-HIGH", "3-medium", "4-NOT SPECIFIED", "5-LOW", "none")])
    asked = customer.select(
        key.alias("req_id"), F.upper("c_mktsegment").alias("country"), words[(F.col("c_nationkey") % 6).cast("int")].alias("state")
    )
    return hierarchy.resolve_state(asked, countries, states)


@query
def lookup_two_level_duplicates(spark, sf):
    """The first country of a name answers, and in it the first state of a name."""
    return _repeated_places(spark, sf)


@query
def lookup_two_level_cities(spark, sf):
    """The cities of all states that were found, each state once."""
    lines = R.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias(POS), F.col("l_orderkey").alias("state_id"), F.col("l_partkey").alias("city")
    )
    return plain(hierarchy.asked_cities(_repeated_places(spark, sf), lines))


@query
def cities_in_state(spark, sf):
    found = hierarchy.cities_in_state(R.doc_requests(spark, sf), project.state_cities(R.doc_state_cities(spark, sf)))
    return found.select(
        "req_id", "status", "msg", F.when(F.col("status") == 200, F.size("cities")).alias("n_cities"),
        digest(F.col("cities")).alias("cities_md5"),
    )


@query
def cities_of(spark, sf):
    number = F.col(POS).cast("string")
    lines = R.doc_cities(spark, sf).withColumn("iso2", F.concat(F.lit("D-"), number))
    found = run_cities_of(R.doc_requests(spark, sf), lines, R.doc_state_cities(spark, sf))
    return found.select(
        "req_id", "status", "msg", F.when(F.col("status") == 200, F.size("cities")).alias("n_cities"),
        digest(F.col("cities")).alias("cities_md5"),
    )


@query
def cities_of_two_sources(spark, sf):
    """Sources that cover different countries, and names that use the first only."""
    number = F.col(POS).cast("string")
    lines = R.doc_cities(spark, sf).withColumn("iso2", F.concat(F.lit("D-"), number))
    covered = lines.join(R.doc_master(spark, sf).select(POS), POS, "left_semi")
    found = run_cities_of(
        R.doc_requests(spark, sf), covered, R.doc_state_cities(spark, sf), exclude_second_source=["Doc 7", "Doc 8"]
    )
    return found.select(
        "req_id", "status", "msg", F.when(F.col("status") == 200, F.size("cities")).alias("n_cities"),
        digest(F.col("cities")).alias("cities_md5"),
    )


@query
def cities_of_duplicates(spark, sf):
    """Fifty names that all documents share, in both sources: the first rows answer."""
    name = F.concat(F.lit("Doc "), (F.col(POS) % 50).cast("string"))
    code = F.concat(F.lit("D-"), (F.col(POS) % 50).cast("string"))
    lines = R.doc_cities(spark, sf).withColumn("country", name).withColumn("iso2", code)
    states = R.doc_state_cities(spark, sf).withColumn("name", name).withColumn("iso2", code)
    asked = R.table(spark, sf, "documents").select(
        F.col("doc_id").alias("req_id"), F.concat(F.lit("DOC "), (F.col("doc_id") % 60).cast("string")).alias("country")
    )
    found = run_cities_of(asked, lines, states)
    return found.select(
        "req_id", "status", "msg", F.when(F.col("status") == 200, F.size("cities")).alias("n_cities"),
        digest(F.col("cities")).alias("cities_md5"),
    )


def _hot_places(spark, sf):
    """Every order asks for one of five documents, by name or code, for an unknown one or for none."""
    kind = F.col("o_custkey") % 8
    name = F.concat(F.lit("DOC "), kind.cast("string"))
    return R.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("req_id"),
        F.when(kind < 4, name).when(kind == 4, "Doc 4").when(kind == 5, "Nowhere").alias("country"),
        F.when(kind == 7, " d-3 ").alias("iso2"),
        F.lit("Line 0 STATE").alias("state"),
    )


def _states_asked(spark, sf):
    states = project.country_states(R.doc_states(spark, sf))
    return lookup.states_answers(_hot_places(spark, sf), states), states


@query
def states_answers(spark, sf):
    """Requests that ask one country many times: one row each, with the id of its list."""
    return _states_asked(spark, sf)[0]


@query
def asked_states(spark, sf):
    """The lists of the countries that some request asked for, each once."""
    names = F.transform("states", lambda s: F.concat_ws(":", s["state_code"], s["name"]))
    return lookup.asked_states(*_states_asked(spark, sf)).select("list_id", F.size("states").alias("n_states"), digest(names).alias("states_md5"))


def _state_cities_asked(spark, sf):
    nested = project.state_cities(R.doc_state_cities(spark, sf))
    return hierarchy.state_answers(_hot_places(spark, sf), nested), nested


@query
def state_answers(spark, sf):
    return _state_cities_asked(spark, sf)[0].select("req_id", "status", "msg", "list_id.row", "list_id.nth")


@query
def asked_state_cities(spark, sf):
    """The cities of the states that some request asked for, each state once."""
    return hierarchy.asked_state_cities(*_state_cities_asked(spark, sf)).select(
        "list_id.row", "list_id.nth", F.size("cities").alias("n_cities"), digest(F.col("cities")).alias("cities_md5")
    )


def _city_lists_asked(spark, sf):
    lines = R.doc_cities(spark, sf).withColumn("iso2", F.concat(F.lit("D-"), F.col(POS).cast("string")))
    nested = R.doc_state_cities(spark, sf)
    return run_cities_answers(_hot_places(spark, sf), lines, nested, exclude_second_source=["Doc 4"]), lines, nested


@query
def cities_answers(spark, sf):
    return _city_lists_asked(spark, sf)[0].select("req_id", "status", "msg", "list_id.one", "list_id.two")


@query
def asked_city_lists(spark, sf):
    """The merged cities of the countries that some request asked for, each list once."""
    return run_asked_city_lists(*_city_lists_asked(spark, sf)).select(
        "list_id.one", "list_id.two", F.size("cities").alias("n_cities"), digest(F.col("cities")).alias("cities_md5")
    )


@query
def merge_nested_lists(spark, sf):
    """Distinct union of two lists per row, first occurrences kept in order."""
    text = R.table(spark, sf, "conversations")
    merged = merge_columns(F.split("text", " "), F.split(F.lower("text"), " "))
    return text.select("conv_id", "turn", F.size(merged).alias("n"), digest(merged).alias("merged_md5"))


# -- filters ------------------------------------------------------------------


@query
def range_inclusive(spark, sf):
    return plain(filters.position_range(project.positions(R.codes(spark, sf)), "long", "1000", "5000"))


@query
def range_text_numbers(spark, sf):
    return plain(filters.position_range(project.positions(R.codes(spark, sf)), "lat", "0", "16"))


@query
def range_other_type(spark, sf):
    return plain(filters.position_range(project.positions(R.codes(spark, sf)), "altitude", "0", "16"))


@query
def range_reversed(spark, sf):
    return plain(filters.position_range(project.positions(R.codes(spark, sf)), "long", "5000", "1000"))


@query
def bounds_gt(spark, sf):
    return plain(filters.greater_than(R.order_facts(spark, sf), "value", "400000"))


@query
def bounds_lt(spark, sf):
    return plain(filters.less_than(R.order_facts(spark, sf), "value", "50000"))


@query
def bounds_both(spark, sf):
    return plain(filters.within(R.nation_facts(spark, sf), "value", "0", "25000000"))


@query
def bounds_on_amounts(spark, sf):
    """The bound dispatch as an expression on two columns of one scan."""
    orders = R.table(spark, sf, "orders")
    kept = bounds(F.col("o_totalprice"), "100000", "") & bounds(F.col("o_custkey"), None, "1000")
    return orders.where(kept).select("o_orderkey", "o_custkey", "o_totalprice")


@query
def name_contains(spark, sf):
    return plain(filters.name_contains(R.part_city_facts(spark, sf), "country", "BRAND#1"))


@query
def drop_leading_null(spark, sf):
    """'blue bolt' is nulled, so it sorts as 'null' and is not the first city: all stay."""
    rows = run_filter_city_population(R.part_city_facts(spark, sf, "blue bolt"), order_by="name", order="dsc")
    return series.unnest_series(rows).select("city", "country", "idx", "year", "value")


@query
def drop_leading_null_by_value(spark, sf):
    """The city of the first part is nulled and has the least first value: it goes."""
    rows = run_filter_city_population(R.part_city_facts(spark, sf, "small ring"), order_by="population")
    return series.unnest_series(rows).select("city", "country", "idx", "year", "value")


# -- order, limit, sample -----------------------------------------------------


def _customers(spark, sf):
    return R.table(spark, sf, "customer").select(
        F.col("c_custkey").alias(POS), F.col("c_mktsegment").alias("country"), F.col("c_acctbal").alias("value")
    )


@query
def order_name_asc(spark, sf):
    return plain(order.order_rows(_customers(spark, sf), "asc", "name"))


@query
def order_name_dsc(spark, sf):
    return plain(order.order_rows(_customers(spark, sf), "dsc", " Name "))


@query
def order_name_other_word(spark, sf):
    return plain(order.order_rows(_customers(spark, sf), "desc", "name"))


@query
def order_value_asc(spark, sf):
    return plain(order.order_rows(_customers(spark, sf), "asc", "population"))


@query
def order_value_dsc(spark, sf):
    return plain(order.order_rows(_customers(spark, sf), " DSC ", "population"))


@query
def order_top(spark, sf):
    """A top-k: here the cut is the feature."""
    return plain(order.order_rows(_customers(spark, sf), "dsc", "name", limit="100"))


@query
def order_capitals(spark, sf):
    return plain(order.capitals_in_order(project.capitals(R.master(spark, sf))))


@query
def limit_edge(spark, sf):
    """The same sorted table under limits of each kind."""
    cases = {
        "2.7": "fraction", "0": "zero", "-1": "negative", "abc": "text", " 3 ": "blanks", "0x4": "hex", "1e12": "huge", None: "none",
    }
    parts = [
        order.order_rows(_customers(spark, sf), "dsc", "population", limit=n).withColumn("kind", F.lit(kind))
        for n, kind in cases.items()
    ]
    return plain(reduce(DataFrame.unionByName, parts))


@query
def limit_beyond_top_k(spark, sf):
    """A limit above the top-k bound."""
    facts = R.order_facts(spark, sf).select(POS, "country", "value")
    return plain(order.order_rows(facts, "dsc", "population", limit=12_000))


@query
def sample_rows(spark, sf):
    return order.sample_rows(R.codes(spark, sf), n=10, seed=7, pos=POS).drop(POS)


# -- set operations -----------------------------------------------------------


def _members(spark, sf, exclude=()):
    customer = R.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("city"), F.col("c_custkey").alias(POS)
    )
    supplier = R.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("country"),
        F.when(F.col("s_acctbal") > 5000, "BUILDING").otherwise(F.col("s_name")).alias("city"),
        F.col("s_suppkey").alias(POS),
    )
    names = R.table(spark, sf, "nation").select(F.col("n_nationkey").alias("country"), "n_name")

    def named(df):
        return df.join(names, "country").select(F.col("n_name").alias("country"), "city", POS)

    return plain(merge.merge_members(named(customer), named(supplier), "country", "city", exclude))


@query
def merge_lists(spark, sf):
    return _members(spark, sf)


@query
def suppress_source(spark, sf):
    return _members(spark, sf, ["NATION_3", "nation_4"])


# -- composed reports ---------------------------------------------------------


@query
def filter_population(spark, sf):
    """Nations by their order total of one year, within bounds, highest first."""
    return plain(
        run_filter_population(
            R.nation_facts(spark, sf), year="1997", gt="0", lt="1000000000000", order="dsc", limit="10"
        )
    )


@query
def filter_population_all_years(spark, sf):
    """Customers' first order of a year; code and order taken from all years."""
    rows = run_filter_population(
        R.order_facts(spark, sf), year=1998, gt="1000", lt="400000", order="asc", order_by="name"
    )
    return plain(rows)


@query
def filter_population_default_year(spark, sf):
    return plain(run_filter_population(R.order_facts(spark, sf)))


@query
def filter_population_nested(spark, sf):
    rows = as_population_counts(run_filter_population(R.order_facts(spark, sf), year="1996", lt="200000"))
    return rows.select("country", "code", "populationCounts.year", "populationCounts.value")


@query
def filter_population_no_figure(spark, sf):
    """Urgent orders stand for "no figure": customers whose first order of the year is one are left out."""
    facts = R.order_facts(spark, sf).join(
        R.table(spark, sf, "orders").select(F.col("o_orderkey").alias(POS), (F.col("o_orderpriority") == "1-URGENT").alias("urgent")), POS
    )
    facts = facts.withColumn("value", F.when(F.col("urgent"), -1.0).otherwise(F.col("value")))
    return plain(run_filter_population(facts, year="1997", order="dsc"))


@query
def filter_population_by_folder(spark, sf):
    """The same report from facts stored in one folder per year."""
    path = shared_path(spark, f"facts-{uuid.uuid4().hex}")
    write_facts(R.order_facts(spark, sf), path)
    facts, heads = read_facts(spark, path)
    return plain(run_filter_population(facts, year="1999", heads=heads))


@query
def latest_year(spark, sf):
    return series.latest_year(R.order_facts(spark, sf))


@query
def greatest_year(spark, sf):
    return series.greatest_year(R.order_facts(spark, sf))


@query
def filter_city_population(spark, sf):
    rows = run_filter_city_population(R.part_city_facts(spark, sf), limit="20", order="dsc", country="BRAND#2")
    return series.unnest_series(rows).select("city", "country", "idx", "year", "value", "sex", "reliabilty")


@query
def filter_city_population_by_name(spark, sf):
    rows = run_filter_city_population(R.order_city_facts(spark, sf), limit="200", order="dsc", order_by="name")
    return series.unnest_series(rows).select("city", "country", "idx", "year", "value", "sex", "reliabilty")


@query
def country_info(spark, sf):
    info = run_country_info(
        R.master(spark, sf),
        "currency, flag,unicodeFlag,capital ,dialCode,iso2,iso3,IMAGE,image",
        flags=R.flags(spark, sf),
    )
    return plain(info).withColumnsRenamed({"unicodeFlag": "unicode_flag", "dialCode": "dial_code"})


@query
def country_info_lists(spark, sf):
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("lang") == "en", R.doc_name()).otherwise(F.concat(F.lit("DOC "), number))
    master = R.table(spark, sf, "documents").select(F.col("doc_id").alias(POS), name.alias("Name"))
    info = run_country_info(
        master, "cities,states", cities=R.doc_cities(spark, sf), states=R.doc_states(spark, sf)
    )
    return info.select(
        F.col(POS).alias("pos"), "name",
        F.when(F.col("cities").isNotNull(), F.size("cities")).alias("n_cities"),
        digest(F.col("cities")).alias("cities_md5"),
        digest(F.transform("states", lambda s: F.concat_ws(":", s["id"], s["state_code"], s["name"]))).alias("states_md5"),
    )


# -- sources and sinks --------------------------------------------------------


@query
def json_round_trip(spark, sf):
    """Customers written as JSON, nulls left out, and read back with a fixed schema."""
    path = shared_path(spark, f"codes-{uuid.uuid4().hex}")
    codes = R.codes(spark, sf)
    write_result(codes.withColumn("longitude", F.col("longitude").cast("string")), path)
    return plain(load_table(spark, path, schemas.CODES, pos=POS, one_document=False))


@query
def facts_round_trip(spark, sf):
    path = shared_path(spark, f"population-{uuid.uuid4().hex}")
    facts = R.order_facts(spark, sf).withColumnsRenamed(
        {"country": "Country Name", "code": "Country Code", "year": "Year", "value": "Value"}
    )
    write_result(facts, path)
    return plain(load_country_population(spark, path, pos=POS, one_document=False))


@query
def city_facts_round_trip(spark, sf):
    path = shared_path(spark, f"cities-{uuid.uuid4().hex}")
    facts = R.order_city_facts(spark, sf).withColumnsRenamed(
        {
            "city": "City", "country": "Country or Area", "year": "Year", "value": "Value",
            "sex": "Sex", "reliabilty": "Reliability",
        }
    )
    write_result(facts, path)
    return plain(load_city_population(spark, path, pos=POS, one_document=False))


@query
def nested_round_trip(spark, sf):
    path = shared_path(spark, f"states-{uuid.uuid4().hex}")
    write_result(R.doc_state_cities(spark, sf), path)
    nested = load_table(spark, path, schemas.STATE_CITIES, pos=POS, one_document=False)
    words = flatten_cities(F.col("states"))
    return nested.select(
        F.col(POS).alias("pos"), "name", "iso2", "iso3",
        F.size("states").alias("n_states"), F.size(words).alias("n_cities"), digest(words).alias("cities_md5"),
    )


def _through_json(spark, df, schema, name):
    """Written one object per line, and read back with a fixed schema."""
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    write_result(df, path)
    return load_table(spark, path, schema, pos=POS, one_document=False)


@query
def flags_round_trip(spark, sf):
    return plain(_through_json(spark, R.flags(spark, sf), schemas.FLAGS, "flags").select(POS, "name", "flag", "number"))


@query
def master_round_trip(spark, sf):
    back = _through_json(spark, R.master(spark, sf), schemas.MASTER, "master")
    return plain(back.select(POS, *[F.col(c).alias(c.lower()) for c in back.columns if c != POS]))


@query
def states_round_trip(spark, sf):
    back = _through_json(spark, R.doc_states(spark, sf), schemas.STATES, "states")
    whole = F.transform("states", lambda s: F.concat_ws(":", s["id"], s["state_code"], s["name"]))
    return back.select(F.col(POS).alias("pos"), "name", F.size("states").alias("n_states"), digest(whole).alias("states_md5"))


@query
def lists_round_trip(spark, sf):
    back = _through_json(spark, R.doc_cities(spark, sf).select(POS, "country", "cities"), schemas.CITIES, "cities")
    return back.select(F.col(POS).alias("pos"), "country", F.size("cities").alias("n_cities"), digest(F.col("cities")).alias("cities_md5"))


@query
def documents_round_trip(spark, sf):
    """Files that are one JSON array each, of a thousand customers or fewer."""
    path = shared_path(spark, f"arrays-{uuid.uuid4().hex}")
    rows = R.codes(spark, sf)
    arrays = rows.groupBy(F.expr(f"{POS} div 1000")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = load_table(spark, path, schemas.CODES, pos=POS, one_document=True)
    return plain(back.withColumn("longitude", number_of_text(F.col("longitude"))))


@query
def file_order_round_trip(spark, sf):
    """Many files without an ordinal column: files by path, rows by place, numbered from 0."""
    path = shared_path(spark, f"ordered-{uuid.uuid4().hex}")
    R.codes(spark, sf).repartitionByRange(7, POS).sortWithinPartitions(POS).drop(POS).write.json(path)
    back = load_table(spark, path, schemas.CODES, one_document=False)
    return series.with_ordinals(back.select(F.lit("all").alias("table"), POS, "name"), "table", POS, "nth").select("nth", "name")


@query
def response_envelope(spark, sf):
    answers = respond(lookup_currency(spark, sf))
    return answers.select("req_id", "status", "error", "msg", "data.name", "data.currency", F.col("data.iso2").alias("iso_a2"), F.col("data.iso3").alias("iso_a3"))


# -- rates and streams --------------------------------------------------------

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
    ]
)


def _event_stream(spark, sf):
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)


def _event_requests(events):
    name = R.customer_name("user_id")
    country = F.when(F.col("event_type") == "click", F.upper(name)).when(F.col("event_type") == "view", name)
    iso2 = F.when(F.col("event_type") == "error", "zz").when(
        F.col("event_type") == "purchase", F.concat(F.lit("c-"), F.col("user_id").cast("string"))
    )
    return events.select(F.col("event_id").alias("req_id"), country.alias("country"), iso2.alias("iso2"))


@query
def rate_breaches(spark, sf):
    events = R.table(spark, sf, "events").select("ts", "user_id")
    found = run_rate_breaches(events, client="user_id", window="1 day", max_requests=5)
    return found.select("client", F.col("window_start").cast("date").alias("day"), "n", "rejected")


@query
def rate_breaches_stream(spark, sf):
    """The same on a stream, at the end of its input: open days too."""
    found = run_rate_breaches(
        _event_stream(spark, sf), client="user_id", window="1 day", max_requests=5, lateness="1 hour"
    )
    path = shared_path(spark, f"rates-{uuid.uuid4().hex}")
    return land_latest(found, path, ["client", "window_start"]).select("client", F.col("window_start").cast("date").alias("day"), "n", "rejected")


@query
def lookup_stream(spark, sf):
    codes = project.dial_codes(R.codes(spark, sf))
    keys = [Key("country", "name"), Key("iso2", "code")]
    requests = _event_requests(_event_stream(spark, sf))
    stream = run_lookup_stream(requests, codes, keys, ["name", "code", "dial_code"], MSG_DIAL_CODE)
    return land(stream, shared_path(spark, f"landed-{uuid.uuid4().hex}"))


@query
def lookup_stream_as_batch(spark, sf):
    requests = _event_requests(R.table(spark, sf, "events"))
    return lookup.dial_code_of(requests, project.dial_codes(R.codes(spark, sf)))


@query
def lookup_kept_answers(spark, sf):
    """Answers kept for a dimension that arrives in three lots, least positions last."""
    path = shared_path(spark, f"grown-{uuid.uuid4().hex}")
    codes = project.dial_codes(R.codes(spark, sf))
    keys = [Key("country", "name"), Key("iso2", "code")]
    for lot in (2, 1, 0):
        codes.where(F.col(POS) % 3 == lot).write.mode("append").parquet(f"{path}/rows")
        stream = spark.readStream.schema(codes.schema).parquet(f"{path}/rows")
        answers = keep_answers(stream, keys, ["name", "code", "dial_code"], f"{path}/kept")
    return answer_with(R.requests(spark, sf), answers, keys, MSG_DIAL_CODE)
