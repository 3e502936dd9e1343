"""One key holds a third of the rows and no side may be broadcast: Spark must split it."""

import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from terralog.operators import lookup, series
from terralog.operators.first_match import enrich_first
from terralog.operators.hierarchy import cities_in_state, cities_in_state_long
from terralog.plans.cities import cities_of
from terralog.plans.population import filter_city_population


@pytest.fixture
def no_broadcast(settings):
    settings(
        autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        adaptive__skewJoin__skewedPartitionFactor="2", adaptive__advisoryPartitionSizeInBytes="20KB",
        adaptive__coalescePartitions__enabled="false", shuffle__partitions="8",
    )


@pytest.fixture
def hot_requests(spark):
    """A third of the requests ask for one key, and another third for none."""
    kind = F.col("id") % 3
    return spark.range(0, 90000, numPartitions=8).select(
        F.col("id").alias("req_id"),
        F.when(kind == 0, "hot").when(kind == 1, F.concat(F.lit("c"), F.col("id") % 5000)).alias("country"),
    )


def names():
    """5000 names, the first of them the hot one."""
    return F.when(F.col("id") == 0, "HOT").otherwise(F.concat(F.lit("C"), "id"))


def test_hot_request_keys_are_split(spark, no_broadcast, hot_requests):
    dim = spark.range(5000).select(
        F.col("id").alias("_pos"),
        F.when(F.col("id") == 0, "HOT").otherwise(F.concat(F.lit("C"), "id")).alias("name"),
        F.col("id").cast("string").alias("code"),
        F.lit("+1").alias("dial_code"),
    )
    answers = lookup.dial_code_of(hot_requests, dim)
    assert "skew=true" in final_plan(answers)
    counts = dict(rows(answers.groupBy("status").count()))
    unknown = hot_requests.where("country = 'c0'").count()
    assert counts == {200: 60000 - unknown, 400: 30000, **({404: unknown} if unknown else {})}
    left = hot_requests.select(F.col("req_id").alias("_pos"), "country")
    rich = enrich_first(left, dim, "country", "name", {"code": "code"})
    assert "skew=true" in final_plan(rich)
    assert rich.count() == 90000 and rich.where("code = '0'").count() == 30000


def test_hot_states_are_split(spark, no_broadcast, hot_requests):
    asked = hot_requests.withColumn("state", F.lit("s"))
    nested = spark.range(5000).select(
        F.col("id").alias("_pos"),
        F.when(F.col("id") == 0, "HOT").otherwise(F.concat(F.lit("C"), "id")).alias("name"),
        F.array(F.struct(F.lit("S").alias("name"), F.array(F.struct(F.lit("x").alias("name"))).alias("cities"))).alias("states"),
    )
    found = cities_in_state(asked, nested)
    assert "skew=true" in final_plan(found)
    assert found.where("cities = array('x')").count() == found.where("status = 200").count() > 50000
    countries = nested.select("_pos", F.col("_pos").alias("country_id"), "name")
    states = countries.select("_pos", F.col("_pos").alias("state_id"), "country_id", F.lit("s").alias("name"))
    long = cities_in_state_long(asked, countries, states, states.select("_pos", "state_id", F.lit("x").alias("city")))
    assert "skew=true" in final_plan(long)
    assert long.count() == 90000 and long.where("city = 'x'").count() == found.where("status = 200").count()


def test_hot_requests_for_merged_cities_are_split(spark, no_broadcast, hot_requests):
    base = spark.range(5000).select(F.col("id").alias("_pos"), names().alias("name"), F.lit(None).cast("string").alias("iso2"))
    cities = base.withColumnRenamed("name", "country").withColumn("cities", F.array(F.lit("x")))
    inner = F.array(F.struct(F.lit("y").alias("name")))
    nested = base.withColumn("states", F.array(F.struct(F.lit("s").alias("name"), inner.alias("cities"))))
    found = cities_of(hot_requests, cities, nested)
    assert "skew=true" in final_plan(found)
    assert found.where("cities = array('x', 'y')").count() == found.where("status = 200").count() > 50000


@pytest.fixture
def hot_facts(spark):
    """A third of the facts belong to one entity."""
    name = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5000))
    return spark.range(0, 90000, numPartitions=8).select(
        F.col("id").alias("_pos"), name.alias("country"), name.alias("city"), F.lit("z").alias("code"),
        F.lit(2000).alias("year"), (F.col("id") * 1.0).alias("value"),
        F.lit("s").alias("sex"), F.lit("r").alias("reliabilty"),
    )


def test_hot_entities_of_a_series_lookup_are_split(spark, no_broadcast, hot_facts):
    asked = spark.range(5000).select(F.col("id").alias("req_id"), names().alias("country"))
    found = series.population_of_country(asked, hot_facts)
    assert "skew=true" in final_plan(found)
    own = series.asked_country_facts(series.country_answers(asked, hot_facts), hot_facts)
    assert "skew=true" in final_plan(own) and own.where("country = 'hot'").count() == 30000
    assert found.where("country = 'hot'").count() == 30000
    assert found.where("status = 200").count() == hot_facts.where("country <> 'c0'").count()


def test_hot_cities_of_a_report_are_split(no_broadcast, hot_facts):
    report = filter_city_population(hot_facts, items_per_part=1000)
    assert "skew=true" in final_plan(report)
    sizes = rows(report.where("city = 'hot'").orderBy("part").selectExpr("size(populationCounts)", "offset"))
    assert sum(n for n, _ in sizes) == 30000 and max(n for n, _ in sizes) < 2000
    assert report.selectExpr("sum(size(populationCounts))").first()[0] == 90000
