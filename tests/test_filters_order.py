import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from terralog.operators import filters, order, project


@pytest.fixture
def positions(table):
    lat = ["0", "", "abc", " 1 ", "0x10", None, "40", "NaN", "-5", "1d"]
    return table("name string, iso2 string, lat string, long double", [(f"c{i}", "x", v, float(i)) for i, v in enumerate(lat)])


def names(df):
    return [r[0] for r in rows(df.orderBy("_pos"), "name")]


def test_range_is_inclusive_and_reads_text(positions):
    assert names(filters.position_range(positions, "lat", "0", "16")) == ["c0", "c1", "c3", "c4"]
    assert names(filters.position_range(positions, "lat", "16", "40")) == ["c4", "c6"]
    assert names(filters.position_range(positions, "long", 1, "3")) == ["c1", "c2", "c3"]


def test_range_does_not_swap_and_other_types_keep_all(positions):
    assert names(filters.position_range(positions, "lat", "16", "0")) == []
    assert names(filters.position_range(positions, "lat", "x", "16")) == []
    assert len(names(filters.position_range(positions, "latitude", "1", "2"))) == 10
    for args in [("", "1", "2"), ("lat", None, "2"), ("lat", "1", "")]:
        with pytest.raises(ValueError, match="missing param"):
            filters.position_range(positions, *args)


def test_nan_is_outside_every_range(table):
    df = table("v double", [1.0, float("nan"), float("inf")])
    assert [r[0] for r in rows(filters.range_filter(df, "v", "0", "Infinity"), "v")] == [1.0, float("inf")]
    assert [r[0] for r in rows(filters.greater_than(df, "v", "0"), "v")] == [1.0, float("inf")]


def test_bounds_on_values_equal_to_them(table):
    df = table("v double", [0.0, 5.0, 10.0])

    def kept(d):
        return [r[0] for r in rows(d.orderBy("v"), "v")]

    assert kept(filters.greater_than(df, "v", "5")) == [10.0]
    assert kept(filters.less_than(df, "v", "5")) == [0.0]
    assert kept(filters.within(df, "v", "0", "10")) == [5.0]
    assert filters.value_bounds(df, "v", "", None) is df


def test_numeric_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select((F.col("id") * 1.0).alias("long")).write.parquet(path)
    plan = final_plan(filters.range_filter(spark.read.parquet(path), "long", "3", "5"))
    assert "GreaterThanOrEqual(long,3.0)" in plan and "LessThanOrEqual(long,5.0)" in plan


TIES = [("b", 2.0), ("A", 1.0), ("a", 2.0), ("B", None), ("c", 1.0)]


def ordered(table, how, by):
    return [r[0] for r in rows(order.order_rows(table("country string, value double", TIES), how, by), "_pos")]


@pytest.mark.parametrize(
    "how,by,expected",
    [
        ("asc", "name", [1, 2, 0, 3, 4]),
        ("dsc", " NAME ", [4, 0, 3, 1, 2]),  # ties keep input order in both directions
        ("desc", "name", [0, 1, 2, 3, 4]),
        ("ASC", "name", [0, 1, 2, 3, 4]),
        (" dsc ", "name", [0, 1, 2, 3, 4]),
        ("asc", "population", [1, 4, 0, 2, 3]),
        (" DSC ", "population", [0, 2, 1, 4, 3]),
        ("desc", "population", [1, 4, 0, 2, 3]),
        ("anything", "anything", [1, 4, 0, 2, 3]),
    ],
)
def test_order(table, how, by, expected):
    assert ordered(table, how, by) == expected


def test_text_values_sort_as_numbers(table):
    df = table("country string, value string", [("a", "10"), ("b", "9"), ("c", "x"), ("d", "")])
    assert [r[0] for r in rows(order.order_rows(df, "asc"), "country")] == ["d", "b", "a", "c"]


def test_sort_and_limit_is_a_top_k(table):
    df = order.order_rows(table("country string, value double", TIES), "dsc", limit="2")
    assert [r[0] for r in rows(df, "_pos")] == [0, 2]
    assert "TakeOrderedAndProject" in final_plan(df)


@pytest.mark.parametrize("limit,n", [(None, 5), (0, 0), ("2.7", 2), (99, 5), ("-1", 0), ("abc", 0), (2**40, 5)])
def test_limit_rows(table, limit, n):
    assert order.limit_rows(table("country string, value double", TIES), limit, [F.col("_pos").asc()]).count() == n


@pytest.mark.parametrize("n", [301, 450, 3000, 9_999, 10_000, 2**40])
def test_a_large_limit_needs_no_single_task(spark, n):
    df = spark.range(10_000, numPartitions=3).select(
        F.col("id").alias("_pos"), F.lit("x").alias("country"), (F.col("id") * 7919 % 50).cast("double").alias("value")
    )
    keys = order.sort_keys(df, "dsc", "population", "country", "value")
    got = order.limit_rows(df, n, keys, top_k=300)
    assert rows(got) == rows(df.orderBy(*keys).limit(min(n, 10_000)))
    assert "SinglePartition" not in final_plan(got)


def test_a_large_limit_over_equal_rows(spark):
    """Keys that tell no rows apart: the cut cannot get smaller, and ends."""
    df = spark.range(5000, numPartitions=3).select(F.lit(1).alias("a"))
    assert order.limit_rows(df, 1234, [F.col("a").asc()], top_k=10).count() == 1234


@pytest.mark.parametrize("size", [1000, 100_000])
def test_the_driver_sees_a_row_per_range(spark, monkeypatch, size):
    """However many rows there are; a small limit runs nothing at all."""
    seen = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    df = spark.range(size, numPartitions=5)
    order.limit_rows(df, 400, [F.col("id").asc()], top_k=400)
    assert seen == []
    assert order.limit_rows(df, size // 2, [F.col("id").desc()], top_k=50).count() == size // 2
    assert 1 <= len(seen) <= 6 and all(len(x) <= 4 for x in seen)


def test_drop_leading(table):
    df = table("city string", ["null", "a", "null"])
    assert [r[0] for r in rows(filters.drop_leading(df.orderBy("_pos"), "city", "null").orderBy("_pos"), "_pos")] == [1, 2]
    assert filters.drop_leading(df.orderBy(F.desc("_pos")), "city", "a").count() == 3
    assert filters.drop_leading(df.where("false").orderBy("_pos"), "city", "null").count() == 0


def test_name_contains(table):
    df = table("country string", ["Nigeria", "Niger", None, "Algeria"])
    assert [r[0] for r in rows(filters.name_contains(df, "country", "NIGER"), "country")] == ["Nigeria", "Niger"]
    for nothing in (None, False, ""):
        assert filters.name_contains(df, "country", nothing) is df


def test_sample_is_whole_rows_and_independent_of_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("_pos"), (F.col("id") * 2).alias("v"))
    one = rows(order.sample_rows(df, 5, seed=3, pos="_pos"))
    assert one == rows(order.sample_rows(df.repartition(7), 5, seed=3, pos="_pos"))
    assert all(v == 2 * p for p, v in one) and len(set(one)) == 5
    assert one != rows(order.sample_rows(df, 5, seed=4, pos="_pos"))
    assert order.sample_rows(df).count() == 1


def test_sample_is_uniform(spark):
    df = spark.range(4).select(F.col("id").alias("_pos"))
    drawn = [rows(order.sample_rows(df, 1, seed=s, pos="_pos"))[0][0] for s in range(60)]
    assert all(drawn.count(i) >= 5 for i in range(4))


def test_capitals_are_in_name_order(table):
    master = table(
        "Name string, Capital string, Iso2 string, Iso3 string", [("beta", "B", "b", "b"), ("Alpha", "A", "a", "a")]
    )
    assert rows(order.capitals_in_order(project.capitals(master)), "name", "capital") == [("Alpha", "A"), ("beta", "B")]


def test_projections(table):
    states = table(
        "name string, iso3 string, iso2 string, states array<struct<id:string,name:string,state_code:string>>",
        [("A", "AAA", "AA", [("1", "s", None)]), ("B", "BBB", "BB", [])],
    )
    slim = project.country_states(states)
    assert slim.schema["states"].dataType.simpleString() == "array<struct<name:string,state_code:string>>"
    assert [r[0] for r in rows(slim, "states")] == [[("s", None)], []]
    cities = table("country string, cities array<string>", [("A ", ["x"]), ("Z", [])])
    master = table("Name string, Iso2 string, Iso3 string", [("a", "AA", "AAA")])
    assert rows(project.countries_and_cities(cities, master).orderBy("_pos")) == [
        (0, "AA", "AAA", "A ", ["x"]), (1, None, None, "Z", []),
    ]
