import pytest
from conftest import final_plan, rows
from hypothesis import HealthCheck, settings
from hypothesis import given as cases
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralog.operators import series
from terralog.plans.population import as_population_counts, filter_city_population, filter_population
from terralog.sources.write import read_facts, write_facts

FACTS = "country string, code string, year int, value double"
SERIES = [
    ("Beta", "BET", 2000, 10.0), ("Beta", "BET", 2001, 11.0), ("Beta", "BET", 1999, 9.0),
    ("alpha", "ALP", 2000, 5.0), ("alpha", "XXX", 2000, 6.0), ("alpha", "ALP", 2001, -1.0),
    ("Gamma", "GAM", 2001, 30.0), (None, "NUL", 1999, 1.0),
]
CITY = "city string, country string, year int, value double, sex string, reliabilty string"
CITIES = [
    ("Twin", "Beta", 2001, 5.0, "Both", "Final"), ("Lone", "Alpha", 2001, 7.0, "Both", "Final"),
    ("Twin", "Alpha", 2000, 99.0, "Male", "Final"), (None, "Beta", 2001, 1.0, "Both", None),
    ("Pair", "beta land", 2001, 7.0, "Both", None),
]


def ran(df):
    return final_plan(df).split("== Initial Plan ==")[0]


@pytest.fixture
def facts(table):
    return table(FACTS, SERIES)


@pytest.fixture
def city_facts(table):
    return table(CITY, CITIES)


def test_country_series(facts):
    got = rows(series.country_series(facts).orderBy("_pos"), "country", "code", "iso3", "part", "populationCounts")
    assert got == [
        ("Beta", "BET", "BET", 0, [(2000, 10.0), (2001, 11.0), (1999, 9.0)]),
        ("alpha", "ALP", "ALP", 0, [(2000, 5.0), (2000, 6.0), (2001, -1.0)]),
        ("Gamma", "GAM", "GAM", 0, [(2001, 30.0)]),
        ("null", "NUL", "NUL", 0, [(1999, 1.0)]),
    ]


def test_city_series_merges_namesakes_under_the_first_country(city_facts):
    got = rows(series.city_series(city_facts).orderBy("_pos"), "city", "country", "populationCounts")
    assert got[0] == ("Twin", "Beta", [(2001, 5.0, "Both", "Final"), (2000, 99.0, "Male", "Final")])
    assert [g[0] for g in got] == ["Twin", "Lone", "null", "Pair"]


POSITIONS = st.one_of(st.integers(0, 300), st.integers(-(2**62), 2**62), st.integers(-70000, 70000).map(lambda n: n * 65536))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@cases(
    st.lists(st.tuples(st.sampled_from("aaaaab"), POSITIONS), min_size=1, max_size=60, unique_by=lambda t: t[1]),
    st.integers(1, 9),
)
def test_parts_are_whole_bounded_and_in_order(spark, data, most):
    """Whatever the spacing and sign of the positions."""
    df = spark.createDataFrame([(p, n, p) for n, p in data], "_pos long, name string, v long").repartition(3)
    nested = series.nest_series(df, "name", ["v"], {"item": "v"}, into="items", items_per_part=most)
    got = rows(nested.orderBy("name", "part"), "name", "v", "_pos", "part", "offset", "items")
    for name in {n for n, _ in data}:
        expected = sorted(p for n, p in data if n == name)
        mine = [r for r in got if r[0] == name]
        assert [i[0] for r in mine for i in r[5]] == expected
        assert all(r[1] == r[2] == expected[0] for r in mine)
        assert [r[4] for r in mine] == [sum(len(x[5]) for x in mine[:k]) for k in range(len(mine))]
        assert [r[3] for r in mine] == list(range(len(mine)))
        assert all(len(r[5]) == most for r in mine[:-1]) and len(mine[-1][5]) <= most


@pytest.mark.parametrize("step", [1, 1_000_003, -70_000])
def test_ordinals_of_a_hot_name(spark, step):
    """Dense, sparse and negative positions, one name across all ranges; windows hold a row per range."""
    df = spark.range(0, 50_000, numPartitions=4).select(
        (F.col("id") * step).alias("at"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 900)).alias("name")
    )
    got = series.with_ordinals(df, "name", "at")
    places = {}
    for name, at in sorted(rows(df, "name", "at")):
        places[name, at] = places.get((name, "n"), 0)
        places[name, "n"] = places[name, at] + 1
    assert {(n, a): i for n, a, i in rows(got, "name", "at", "_idx")} == {k: v for k, v in places.items() if k[1] != "n"}


def test_facts_move_once_or_twice(spark, tmp_path):
    """Entities of one part are nested in one shuffle; of long ones, one more after their ordinals are stored."""
    df = spark.range(0, 5000).selectExpr("id as _pos", "concat('c', id % 7) as country", "'x' as code", "int(id) as year", "id as value")
    df.write.parquet(str(tmp_path / "f"))
    facts = spark.read.parquet(str(tmp_path / "f"))
    plan = ran(series.country_series(facts))
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1 and "Window" not in plan
    plan = ran(series.country_series(facts, items_per_part=100))
    # The stored ordinals hold the facts of long entities; they are shuffled by part, and
    # their join on range and name only moves where the counts are too many to broadcast.
    assert sum("_f0" in x.split("PartitionFilters")[0] for x in plan.split("FileScan")[1:]) <= 2
    assert plan.count("ObjectHashAggregate") == 2 and "SortMergeJoin" not in plan


def test_city_report_reads_facts_twice(spark, tmp_path):
    CITIES_DF = spark.createDataFrame([(k, *row) for k, row in enumerate(CITIES)], f"_pos long, {CITY}")
    CITIES_DF.write.parquet(str(tmp_path / "c"))
    report = filter_city_population(spark.read.parquet(str(tmp_path / "c")), limit=3)
    assert report.count() == 3
    plan = ran(report)
    assert sum("reliabilty" in x for x in plan.split("FileScan")[1:]) == 1


def test_year_report_reads_facts_twice(spark, tmp_path):
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(SERIES)], f"_pos long, {FACTS}")
    df.write.parquet(str(tmp_path / "f"))
    plan = ran(filter_population(spark.read.parquet(str(tmp_path / "f")), year=2000))
    assert plan.count("FileScan") == 2


def test_a_long_entity_is_built_in_many_tasks(spark):
    df = spark.range(0, 30000, numPartitions=4).select(
        F.col("id").alias("_pos"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 500)).alias("name"),
        F.col("id").alias("v"),
    )
    nested = series.nest_series(df, "name", [], {"v": "v"}, into="items", items_per_part=1000)
    hot = rows(nested.where("name = 'hot'").orderBy("part").selectExpr("size(items)", "offset"))
    assert hot == [(1000, 1000 * k) for k in range(10)]
    assert nested.where("name <> 'hot'").count() == 500


def test_unrelated_rows_leave_an_entity_as_it_is(table):
    facts = table(FACTS, SERIES * 3)
    more = facts.unionByName(facts.selectExpr("_pos + 1000 as _pos", "'other' as country", "code", "year", "value"))
    pick = [rows(series.country_series(f, items_per_part=2).where("country = 'Beta'").orderBy("part")) for f in (facts, more)]
    assert pick[0] == pick[1] and len(pick[0]) > 3


def test_unnest_counts_across_parts(facts):
    nested = series.country_series(facts, items_per_part=1)
    got = rows(series.unnest_series(nested).where("country = 'Beta'").orderBy("idx"), "idx", "year")
    assert got == [(0, 2000), (1, 2001), (2, 1999)]


def test_latest_year_is_the_last_of_the_first_country(facts):
    assert rows(series.latest_year(facts)) == [(1999,)]
    assert rows(series.greatest_year(facts)) == [(2001,)]


def population(*args, **kwargs):
    return rows(filter_population(*args, **kwargs), "country", "code", "year", "value")


def test_filter_population_takes_the_first_fact_of_the_year(facts):
    assert population(facts, year="2000") == [("alpha", "ALP", 2000, 5.0), ("Beta", "BET", 2000, 10.0)]
    assert population(facts, year=2000, order="dsc") == [("Beta", "BET", 2000, 10.0), ("alpha", "ALP", 2000, 5.0)]


def test_filter_population_drops_countries_without_a_figure(facts):
    assert population(facts, year=2001) == [("Beta", "BET", 2001, 11.0), ("Gamma", "GAM", 2001, 30.0)]
    assert population(facts, year="1900") == []
    for no_year in ("abc", "2000.5", "Infinity", "1e20"):
        assert population(facts, year=no_year) == []


def test_filter_population_reads_text_facts(facts):
    text = facts.withColumns({"year": F.col("year").cast("string"), "value": F.col("value").cast("string")})
    got = rows(filter_population(text, year="2001", gt="11"), "country", "year", "value")
    assert got == [("Gamma", "2001", "30.0")]


def test_filter_population_default_year(facts):
    assert population(facts) == [("null", "NUL", 1999, 1.0), ("Beta", "BET", 1999, 9.0)]


def test_filter_population_bounds_and_limit(facts):
    assert population(facts, year=2001, gt="11") == [("Gamma", "GAM", 2001, 30.0)]
    assert population(facts, year=2001, lt="30", gt="0") == [("Beta", "BET", 2001, 11.0)]
    assert population(facts, year=2000, limit="1", order_by="name") == [("alpha", "ALP", 2000, 5.0)]
    assert population(facts, year=2000, limit="0") == []
    with pytest.raises(ValueError):
        filter_population(facts, limit="")


def test_code_comes_from_the_first_fact_of_any_year(table):
    df = table(FACTS, [("A", "OLD", 1999, 1.0), ("B", "BBB", 2000, 3.0), ("A", "NEW", 2000, 3.0)])
    assert population(df, year=2000) == [("A", "OLD", 2000, 3.0), ("B", "BBB", 2000, 3.0)]


def test_a_year_reads_only_its_folder_and_gives_the_same_report(spark, table, tmp_path):
    df = table(FACTS, [("A", "OLD", 1999, 1.0), ("B", "BBB", 2000, 3.0), ("A", "NEW", 2000, 3.0), (None, "N", 2000, 9.0)])
    write_facts(df, str(tmp_path / "f"))
    facts, heads = read_facts(spark, str(tmp_path / "f"))
    for args in ({"year": 2000}, {"year": 2000, "order": "dsc", "order_by": "name", "limit": 2}, {"year": 1999}):
        assert rows(filter_population(facts, heads=heads, **args)) == rows(filter_population(df, **args))
    scans = [x for x in final_plan(filter_population(facts, heads=heads, year=2000)).split("FileScan")[1:] if "value" in x.split("ReadSchema")[1][:60]]
    assert scans and all("PartitionFilters: [isnotnull(year" in x for x in scans)


def test_as_population_counts(facts):
    got = rows(as_population_counts(filter_population(facts, year=2000, limit=1)))
    assert got == [("alpha", "ALP", (2000, 5.0))]


def cities(*args, **kwargs):
    return rows(filter_city_population(*args, **kwargs), "city", "country")


def test_city_report_orders_by_the_first_fact(city_facts):
    # 'null' has the least first value and leads, so it is dropped; Lone and Pair tie.
    assert cities(city_facts) == [("Twin", "Beta"), ("Lone", "Alpha"), ("Pair", "beta land")]
    assert cities(city_facts, order="dsc") == [
        ("Lone", "Alpha"), ("Pair", "beta land"), ("Twin", "Beta"), ("null", "Beta"),
    ]
    assert cities(city_facts, order_by="name") == [
        ("Lone", "Alpha"), ("null", "Beta"), ("Pair", "beta land"), ("Twin", "Beta"),
    ]


def test_city_report_filters_before_dropping_and_cuts_after(city_facts):
    assert cities(city_facts, country="BETA", limit="1") == [("Twin", "Beta")]
    assert cities(city_facts, country="alpha") == [("Lone", "Alpha")]
    assert cities(city_facts, country="nowhere") == []
    got = filter_city_population(city_facts, limit=1)
    assert rows(got, "populationCounts") == [([(2001, 5.0, "Both", "Final"), (2000, 99.0, "Male", "Final")],)]


def test_city_report_orders_parts_of_a_long_series(city_facts):
    got = rows(filter_city_population(city_facts, items_per_part=1), "city", "part", "offset")
    assert [g[0] for g in got] == ["Twin", "Twin", "Lone", "Pair"]
    assert [g[2] for g in got[:2]] == [0, 1]


def test_population_lookups(table, facts, city_facts):
    asked = table(
        "req_id long, country string, iso3 string, city string",
        [
            (0, " BETA", None, "twin "), (1, "Beta", "gam", "nowhere"), (2, "Beta", "zz", ""), (3, "", "", None),
            (4, "x", None, "NULL"),
        ],
        pos=False,
    )
    got = rows(
        series.population_of_country(asked, facts).orderBy("req_id", "_pos"),
        "req_id", "status", "msg", "country", "code", "year", "value",
    )
    assert got == [
        (0, 200, "Beta with population", "Beta", "BET", 2000, 10.0),
        (0, 200, "Beta with population", "Beta", "BET", 2001, 11.0),
        (0, 200, "Beta with population", "Beta", "BET", 1999, 9.0),
        (1, 200, "Gamma with population", "Gamma", "GAM", 2001, 30.0),
        (2, 404, "country data not found", None, None, None, None),
        (3, 400, "missing param (country or iso3)", None, None, None, None),
        (4, 404, "country data not found", None, None, None, None),
    ]
    got = rows(
        series.population_of_city(asked, city_facts).orderBy("req_id", "_pos"),
        "req_id", "status", "msg", "city", "country", "value",
    )
    assert got == [
        (0, 200, "twin  with population", "Twin", "Beta", 5.0),
        (0, 200, "twin  with population", "Twin", "Beta", 99.0),
        (1, 404, "city data not found", None, None, None),
        (2, 400, "missing param (city)", None, None, None),
        (3, 400, "missing param (city)", None, None, None),
        (4, 200, "NULL with population", "null", "Beta", 1.0),
    ]


def test_answers_and_asked_facts_do_not_multiply(spark, facts):
    """Many requests for one country: rows out are requests and facts, not one times the other."""
    asked = spark.range(500).select(F.col("id").alias("req_id"), F.when(F.col("id") % 2 == 0, "beta").otherwise("alpha").alias("country"))
    answers = series.country_answers(asked, facts)
    assert answers.count() == 500 and answers.where("status = 200").count() == 500
    found = series.asked_country_facts(answers, facts)
    assert sorted(rows(found, "country", "year", "value")) == sorted((n, y, v) for n, _, y, v in SERIES if n in ("Beta", "alpha"))
    assert series.population_of_country(asked, facts).count() == 1500


def test_reports_and_lookups_aggregate_positions_only(facts, city_facts, table):
    """No sort before the map-side combine: texts and lists stay out of the aggregates."""
    asked = table("req_id long, country string, city string", [(0, "beta", "twin")], pos=False)
    for df in (
        filter_population(facts, year=2000, limit=2), filter_city_population(city_facts, limit=2, country="b"),
        series.country_answers(asked, facts), series.city_answers(asked, city_facts),
    ):
        assert "SortAggregate" not in final_plan(df)
