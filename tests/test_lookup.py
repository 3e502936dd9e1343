import pytest
from conftest import rows
from pyspark.sql import functions as F

from terralog.operators import lookup, project
from terralog.operators.first_match import enrich_first, first_by, match_key
from terralog.operators.hierarchy import cities_in_state, cities_in_state_long
from terralog.operators.lookup import Key, lookup_first
from terralog.sources.write import respond

CODES = "name string, dial_code string, iso2 string, code string, latitude string, longitude double"


@pytest.fixture
def codes(table):
    return table(
        CODES,
        [
            ("Ambria", "+1", "AM", "AM", "1", 1.0),
            ("Twin", "+2", "TA", "TA", "2", 2.0),
            ("Twin", "+3", "TB", "TB", "3", 3.0),  # same name, other code
            ("Later", "+4", "AM", "AM", "4", 4.0),  # same code, other name
            (" Padded ", "+5", " PA ", " PA ", "5", 5.0),
            (None, "+6", None, None, "6", 6.0),
        ],
    )


def ask(table, *requests):
    return table("req_id long, country string, iso2 string", [(i, *r) for i, r in enumerate(requests)], pos=False)


def test_status_message_and_first_match(table, codes):
    requests = ask(
        table, ("aMBRIA ", None), ("twin", ""), (None, "tb"), (None, " am\t"), ("PADDED", None), (None, "pa"),
        ("twin", "zz"), ("nowhere", "AM"), ("nowhere", None), (None, None), ("", ""), (" ", None),
    )
    got = rows(lookup.dial_code_of(requests, project.dial_codes(codes)).orderBy("req_id"))
    assert got == [
        (0, 200, "Ambria dial code retrieved", "Ambria", "AM", "+1"),
        (1, 200, "Twin dial code retrieved", "Twin", "TA", "+2"),
        (2, 200, "Twin dial code retrieved", "Twin", "TB", "+3"),
        (3, 200, "Ambria dial code retrieved", "Ambria", "AM", "+1"),
        (4, 200, " Padded  dial code retrieved", " Padded ", " PA ", "+5"),
        (5, 200, " Padded  dial code retrieved", " Padded ", " PA ", "+5"),
        (6, 404, "country not found", None, None, None),  # the code wins though it matches nothing
        (7, 200, "Ambria dial code retrieved", "Ambria", "AM", "+1"),
        (8, 404, "country not found", None, None, None),
        (9, 400, "missing param (country or iso2)", None, None, None),
        (10, 400, "missing param (country or iso2)", None, None, None),
        (11, 404, "country not found", None, None, None),  # blank is given, but unknown
    ]


def test_one_request_and_fields_not_given(spark, table, codes):
    assert rows(lookup.dial_code_of(lookup.request(spark, country="ambria"), codes), "status", "dial_code") == [(200, "+1")]
    assert rows(lookup.dial_code_of(lookup.request(spark), codes), "status") == [(400,)]
    only_name = table("req_id long, country string", [(1, "twin")], pos=False)
    assert rows(lookup.dial_code_of(only_name, codes), "req_id", "dial_code") == [(1, "+2")]


def test_a_key_of_one_kind_never_matches_the_other(table, codes):
    requests = ask(table, ("AM", None), (None, "Ambria"))
    assert [r[1] for r in rows(lookup.dial_code_of(requests, codes))] == [404, 404]


def test_texts_of_each_lookup(table, codes):
    master = table(
        "Iso2 string, Name string, Iso3 string, Unicode string, Currency string, Capital string",
        [("AM", "Ambria", "AMB", "U+1", "AMD", "Amb")],
    )
    flags = table("name string, flag string, number string", [("ambria ", "url", "1"), ("Unlisted", "url2", "2")])
    asked = ask(table, ("Ambria", None), ("x", None), (None, None))

    def texts(df):
        return [r[0] for r in rows(df.orderBy("req_id"), "msg")]

    missing = "missing param (country or iso2)"
    assert texts(lookup.position_of(asked, project.positions(codes))) == [
        "country position retrieved", "Country not found", missing,
    ]
    assert texts(lookup.currency_of(asked, project.currencies(master))) == [
        "Ambria and currency retrieved", "country not found", missing,
    ]
    assert texts(lookup.iso_of(asked, project.iso_codes(flags, master))) == [
        "country's ISO code retrieved", "country not found", "missing param (country)",
    ]
    assert texts(lookup.capital_of(asked, project.capitals(master))) == [
        "country and capitals retrieved", "country not found", missing,
    ]
    assert texts(lookup.flag_image_of(asked, project.flag_images(flags, master))) == [
        "ambria  and flag retrieved", "country not found", missing,
    ]
    assert texts(lookup.unicode_flag_of(asked, project.unicode_flags(master))) == [
        "Ambria and unicode flag retrieved", "country not found", missing,
    ]
    # A flag without iso codes is not found by any code, and does not fail.
    assert rows(lookup.flag_image_of(ask(table, (None, "AM")), project.flag_images(flags, master)), "status", "flag") == [
        (200, "url")
    ]


def test_find_by_is_untrimmed(table, codes):
    asked = ask(table, ("AMBRIA", None), ("ambria ", None))
    found = lookup.find_by(asked, codes.select("_pos", "name", "dial_code"), "country", "name")
    assert sorted(rows(found, "req_id", "status", "dial_code")) == [(0, 200, "+1"), (1, 404, None)]


def test_kept_columns_must_not_clash(table, codes):
    with pytest.raises(ValueError, match="clash"):
        lookup_first(ask(table, ("a", None)), codes, [Key("country", "name")], ["name"], "x", keep=["name"])


def test_envelope_drops_data_of_errors(table, codes):
    answers = lookup.dial_code_of(ask(table, ("Ambria", None), ("x", None)), codes)
    got = respond(answers).orderBy("req_id").toJSON().collect()
    assert got == [
        '{"req_id":0,"status":200,"error":false,"msg":"Ambria dial code retrieved",'
        '"data":{"name":"Ambria","code":"AM","dial_code":"+1"}}',
        '{"req_id":1,"status":404,"error":true,"msg":"country not found"}',
    ]
    blank = answers.withColumn("status", F.lit(None).cast("int")).withColumn("msg", F.lit(None).cast("string"))
    assert set(rows(respond(blank), "status", "msg")) == {(422, "an error occurred")}
    unnamed = answers.withColumn("msg", F.lit(None).cast("string")).where("status = 200")
    assert rows(respond(unnamed), "msg") == [("successs",)]


def test_enrich_first(table):
    left = table("country string, iso3 string", [("TWIN ", None), ("none", "x"), (None, "y"), ("twin", "z")])
    right = table("Name string, Iso2 string, Iso3 string", [(None, "N", "N"), ("Twin", "A", "AAA"), ("twin", "B", "BBB")])
    got = rows(enrich_first(left, right, "country", "Name", {"iso2": "Iso2", "iso3": "Iso3"}).orderBy("_pos"))
    assert got == [(0, "TWIN ", None, "A"), (1, "none", "x", None), (2, None, "y", None), (3, "twin", "z", "A")]
    assert enrich_first(left, right, "country", "Name", {"iso3": "Iso3"}) is left


def test_match_keys_do_not_collide(table):
    df = table("a string, b string", [("x:y", "z"), ("x", "y:z"), ("x", None), (None, "z")])
    keys = [r[0] for r in rows(df.select(match_key("t", F.col("a"), F.col("b"))))]
    assert keys[0] != keys[1] and keys[2:] == [None, None]


def test_first_by_takes_the_lowest_position_not_the_first_read(table):
    df = table("k string, v string", [("a", "x"), ("a", None), ("b", "y")]).orderBy(F.desc("_pos"))
    assert sorted(rows(first_by(df, ["k"], ["v"]).select("k", "answer.v"))) == [("a", "x"), ("b", "y")]


NESTED = "name string, iso2 string, states array<struct<name:string,cities:array<struct<name:string>>>>"


@pytest.fixture
def nested(table):
    return table(
        NESTED,
        [
            ("Ambria", "AM", [(" North State ", [("n1",), ("n2",)]), (" South ", [("s1",)]), ("Empty", [])]),
            ("ambria", "AX", [("Other", [("o1",)])]),  # a later namesake is not reached
            ("Dup", "DU", [("Same", [("first",)]), ("same", [("second",)])]),
            ("Bare", "BA", None),
        ],
    )


PLACES = [
    ("AMBRIA", "north state", 200, "cities in state north state of country AMBRIA retrieved", ["n1", "n2"]),
    ("Ambria", " south ", 200, "cities in state  south  of country Ambria retrieved", ["s1"]),
    ("Ambria", "south", 404, "state not found", None),
    ("Ambria", " north state ", 404, "state not found", None),
    ("Ambria", "Empty", 200, "cities in state Empty of country Ambria retrieved", []),
    ("Ambria", "Other", 404, "state not found", None),
    ("dup", "SAME", 200, "cities in state SAME of country dup retrieved", ["first"]),
    ("Bare", "x", 404, "state not found", None),
    ("ambria ", "Empty", 404, "country not found", None),
    ("", "Empty", 400, "missing param (country)", None),
    (None, None, 400, "missing param (country)", None),
    ("Ambria", "", 400, "missing param (state)", None),
    ("Nowhere", None, 400, "missing param (state)", None),
]


def test_cities_in_state_nested(table, nested):
    asked = table("req_id long, country string, state string", [(i, *p[:2]) for i, p in enumerate(PLACES)], pos=False)
    got = rows(cities_in_state(asked, nested).orderBy("req_id"))
    assert got == [(i, *p[2:]) for i, p in enumerate(PLACES)]


def test_cities_in_state_long_equals_nested(table, nested):
    asked = table("req_id long, country string, state string", [(i, *p[:2]) for i, p in enumerate(PLACES)], pos=False)
    countries = nested.select("_pos", F.col("_pos").alias("country_id"), "name")
    states = nested.select("_pos", F.posexplode("states").alias("i", "s")).select(
        (F.col("_pos") * 10 + F.col("i")).alias("_pos"),
        (F.col("_pos") * 10 + F.col("i")).alias("state_id"),
        F.col("_pos").alias("country_id"), "s.name", "s.cities",
    )
    cities = states.select("state_id", F.posexplode("cities").alias("i", "c")).select(
        (F.col("state_id") * 10 + F.col("i")).alias("_pos"), "state_id", F.col("c.name").alias("city")
    )
    got = rows(cities_in_state_long(asked, countries, states, cities).orderBy("req_id", "_pos"), "req_id", "status", "msg", "city")
    expected = [
        (i, status, msg, city) for i, (_, _, status, msg, found) in enumerate(PLACES) for city in (found or [None])
    ]
    assert got == expected
