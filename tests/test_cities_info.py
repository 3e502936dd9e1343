import pytest
from conftest import final_plan, rows
from pyspark.sql import functions as F

from terralog.operators import hierarchy, lookup
from terralog.operators.merge import merge_members
from terralog.plans import cities as cities_plan
from terralog.plans.cities import cities_of
from terralog.plans.info import country_info

NESTED = "name string, iso2 string, states array<struct<name:string,cities:array<struct<name:string>>>>"


@pytest.fixture
def first(table):
    return table(
        "iso2 string, country string, cities array<string>",
        [
            ("AM", "Ambria", ["a", "b", "a", "B"]),
            ("TR", "Turkey", ["x", "y", "x"]),
            (None, "Uncoded", ["u"]),
            ("AM", "Other", ["o"]),
            ("LO", "Lone", None),
        ],
    )


@pytest.fixture
def second(table):
    return table(
        NESTED,
        [
            ("ambria", " am ", [("p", [("b",), ("c",)]), ("q", None), ("r", [("a",), ("c",), ("d",)])]),
            ("Turkey", "TR", [("p", [("z",)])]),
            ("Second", "SE", [("p", [("s",), ("s",)])]),
        ],
    )


def ask(table, *requests):
    return table("req_id long, country string, iso2 string", [(i, *r) for i, r in enumerate(requests)], pos=False)


def test_cities_of(table, first, second):
    asked = ask(
        table, ("AMBRIA", None), ("x", "Am "), ("Turkey", None), ("turkey", None), (None, "TR"), ("Turkey", "TR"),
        ("Second", None), ("Uncoded", None), ("Ambria ", None), ("Ambria", "zz"), (None, ""), ("LONE", None),
        ("Turkey", "SE"),
    )
    found = ["a", "b", "B", "c", "d"]
    assert rows(cities_of(asked, first, second).orderBy("req_id")) == [
        (0, 200, "cities in Ambria retrieved", found),
        (1, 200, "cities in Ambria retrieved", found),
        (2, 200, "cities in Turkey retrieved", ["x", "y"]),  # exactly this spelling sees one source
        (3, 200, "cities in Turkey retrieved", ["x", "y", "z"]),
        (4, 200, "cities in Turkey retrieved", ["x", "y", "z"]),
        (5, 200, "cities in Turkey retrieved", ["x", "y"]),
        (6, 200, "cities in Second retrieved", ["s"]),
        (7, 200, "cities in Uncoded retrieved", ["u"]),
        (8, 404, "country not found", None),  # names compare untrimmed
        (9, 404, "country not found", None),
        (10, 400, "missing param (country or iso2)", None),
        (11, 200, "cities in Lone retrieved", []),
        (12, 200, "cities in Second retrieved", []),
    ]


def test_cities_of_with_other_exclusions(table, first, second):
    asked = ask(table, ("Ambria", None), ("Turkey", None))
    got = rows(cities_of(asked, first, second, exclude_second_source=["Ambria"]).orderBy("req_id"), "cities")
    assert got == [(["a", "b", "B"],), (["x", "y", "z"],)]
    got = rows(cities_of(asked, first, second, exclude_second_source=[]).orderBy("req_id"), "cities")
    assert got[0] == (["a", "b", "B", "c", "d"],)


def test_lists_stay_out_of_aggregates(table, first, second):
    plan = final_plan(cities_of(ask(table, ("Ambria", None)), first, second)).split("Initial Plan")[0]
    assert "SortAggregate" not in plan and plan.count("array_union") + plan.count("array_distinct") > 0


def test_merge_members(table):
    one = table("country string, city string", [("A", "x"), ("A", "y"), ("A", "x"), ("B", "x")])
    two = table("country string, city string", [("A", "X"), ("A", "y"), ("A", "z"), ("B", "w"), (None, "n")])
    got = rows(merge_members(one, two, "country", "city", ["B"]).orderBy("country", "source", "_pos"))
    assert got == [
        (None, "n", 2, 4), ("A", "x", 1, 0), ("A", "y", 1, 1), ("A", "X", 2, 0), ("A", "z", 2, 2), ("B", "x", 1, 3),
    ]


MASTER = "Iso2 string, Name string, Iso3 string, Unicode string, Dial string, Currency string, Capital string"


@pytest.fixture
def master(table):
    return table(
        MASTER,
        [("AM", "Ambria", "AMB", "U+1", "+1", "AMD", "Amb"), ("ZZ", "Zed ", "", "", " ", "", ""), ("N", None, "N", "U", "1", "c", "d")],
    )


def test_info_columns_follow_the_selectors(master):
    info = country_info(master, "currency, capital ,IMAGE,Iso2,dialCode,iso3")
    assert info.columns == ["_pos", "name", "currency", "capital", "dialCode", "iso3"]
    assert info.orderBy("_pos").drop("_pos").toJSON().collect()[:2] == [
        '{"name":"Ambria","currency":"AMD","capital":"Amb","dialCode":"+1","iso3":"AMB"}',
        '{"name":"Zed ","dialCode":" "}',
    ]
    assert country_info(master, " ").columns == ["_pos", "name"]


def test_info_joins_compare_keys_as_each_table_does(table, master):
    flags = table("name string, flag string, number string", [("AMBRIA", "url", "1"), ("ambria", "later", "2"), ("zed", "u", "3"), ("ZED ", "", "4")])
    cities = table("country string, cities array<string>", [("ambria", ["no"]), ("Ambria", ["c"]), ("Zed ", [])])
    states = table(
        "name string, states array<struct<id:string,name:string,state_code:string>>",
        [("AMBRIA", [("1", "s", None)]), ("Zed", [("2", "t", "T")])],
    )
    info = country_info(master, "flag,cities,states", flags, cities, states).orderBy("_pos")
    assert rows(info, "name", "flag", "cities", "states") == [
        ("Ambria", "url", ["c"], [("1", "s", None)]), ("Zed ", None, [], None), (None, None, None, None),
    ]


def test_info_joins_only_what_is_asked_for(master):
    assert "Join" not in final_plan(country_info(master, "capital"))
    with pytest.raises(ValueError, match="flag"):
        country_info(master, "flag")
    with pytest.raises(ValueError, match="you must specify"):
        country_info(master, "")


def test_lists_by_id_do_not_multiply(spark, table):
    """Many requests for one country: rows out are requests and lists, not a list for each request."""
    cities = table("iso2 string, country string, cities array<string>", [("A", "Ambria", ["x", "y"]), ("B", "Bel", ["z"])])
    states = table(
        "iso2 string, iso3 string, name string, states array<struct<name: string, cities: array<struct<name: string>>>>",
        [("A", "AMB", "Ambria", [("North", [("y",), ("w",)]), ("South State ", [("v",)]), ("North", [("no",)])]), ("C", "CEL", "Cel", None)],
    )
    n = 400
    kind = F.col("id") % 4
    asked = spark.range(n).select(
        F.col("id").alias("req_id"),
        F.when(kind < 2, "AMBRIA").when(kind == 2, "cel").otherwise("Ambria").alias("country"),
        F.when(kind == 0, "north").when(kind == 1, "south state").otherwise("west").alias("state"),
    )
    answers = cities_plan.cities_answers(asked, cities, states, exclude_second_source=["Ambria"])
    lists = cities_plan.asked_city_lists(answers, cities, states)
    assert answers.count() == n and dict(rows(answers.groupBy("status").count())) == {200: n}
    assert sorted(rows(lists.select("list_id.one", "list_id.two", "cities")), key=str) == [
        (0, 0, ["x", "y", "w", "v", "no"]), (0, None, ["x", "y"]), (None, 1, []),
    ]
    whole = cities_plan.cities_of(asked, cities, states, exclude_second_source=["Ambria"])
    joined = answers.join(lists, answers["list_id"].eqNullSafe(lists["list_id"]), "left").select("req_id", "status", "msg", "cities")
    assert sorted(rows(whole)) == sorted(rows(joined))
    found = hierarchy.state_answers(asked, states)
    assert dict(rows(found.groupBy("status").count())) == {200: n // 2, 404: n // 2}
    inner = hierarchy.asked_state_cities(found, states)
    assert sorted(rows(inner.select("list_id.row", "list_id.nth", "cities"))) == [(0, 0, ["y", "w"]), (0, 1, ["v"])]
    named = lookup.states_answers(asked, states)
    assert named.count() == n and "states" not in named.columns
    assert sorted(rows(lookup.asked_states(named, states).select("list_id", F.size("states")))) == [(0, 3), (1, None)]
    assert lookup.asked_states(named.where("false"), states).count() == 0
