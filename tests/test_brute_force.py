"""Operators against plain Python on random small tables."""

from conftest import rows
from hypothesis import HealthCheck, settings
from hypothesis import given as cases
from hypothesis import strategies as st

from terralog.functions.text import BLANKS
from terralog.operators.first_match import enrich_first
from terralog.operators.lookup import Key, lookup_first
from terralog.operators.merge import merge_members
from terralog.operators.order import order_rows
from terralog.plans.cities import cities_of
from terralog.plans.population import filter_population

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
names = st.sampled_from(["a", "A", " a", "b ", "B", "\tc", "", " ", "d", None])
codes = st.sampled_from(["x", " X", "y", "", None, "z"])


def fold(text):
    return None if text is None else text.strip(BLANKS).lower()


def first(items, test):
    return next((i for i in items if test(i)), None)


@quick
@cases(st.lists(st.tuples(names, codes), min_size=1, max_size=8), st.lists(st.tuples(names, codes), min_size=1, max_size=8))
def test_lookup(spark, table, dim, asked):
    found = lookup_first(
        table("req_id long, country string, iso2 string", [(i, *a) for i, a in enumerate(asked)], pos=False),
        table("name string, code string", dim).repartition(3),
        [Key("country", "name"), Key("iso2", "code")], ["_pos"], "x",
    )
    expected = []
    for i, (country, iso2) in enumerate(asked):
        hit = None
        if country:
            hit = first(range(len(dim)), lambda p: fold(dim[p][0]) == fold(country))
        if iso2:
            hit = first(range(len(dim)), lambda p: fold(dim[p][1]) == fold(iso2))
        expected.append((i, 400 if not (country or iso2) else 404 if hit is None else 200, hit))
    assert rows(found.orderBy("req_id"), "req_id", "status", "_pos") == expected


@quick
@cases(st.lists(names, min_size=1, max_size=8), st.lists(names, min_size=1, max_size=8))
def test_enrich(spark, table, left, right):
    got = enrich_first(table("k string", left), table("name string", right).repartition(3), "k", "name", {"at": "_pos"})
    expected = [
        (i, None if k is None else first(range(len(right)), lambda p: fold(right[p]) == fold(k)))
        for i, k in enumerate(left)
    ]
    assert rows(got.orderBy("_pos"), "_pos", "at") == expected


FACT = st.tuples(st.sampled_from(["p", "q", "Q", None]), st.sampled_from([2000, 2001]), st.sampled_from([-1.0, 0.0, 3.0, 7.0]))


@quick
@cases(
    st.lists(FACT, min_size=1, max_size=12), st.sampled_from([None, "2000", 2001]), st.sampled_from([None, "", "0", "3"]),
    st.sampled_from([None, "7"]), st.sampled_from(["asc", "dsc", "DSC", "up"]), st.sampled_from(["name", "population"]),
    st.sampled_from([None, "2", "0"]),
)
def test_population_report(spark, table, data, year, gt, lt, order, by, limit):
    facts = table("country string, code string, year int, value double", [(n, f"{n}{i}", y, v) for i, (n, y, v) in enumerate(data)])
    got = filter_population(facts.repartition(3), year, limit, gt, lt, order, by)
    groups = {}
    for i, (name, y, value) in enumerate(data):
        groups.setdefault(name or "null", []).append((f"{name}{i}", y, value))
    wanted = int(year) if year is not None else next(iter(groups.values()))[-1][1]
    kept = []
    for name, items in groups.items():
        hit = first(items, lambda f: f[1] == wanted)
        if hit and hit[2] != -1:
            kept.append((name, items[0][0], wanted, hit[2]))
    if by == "name":
        if order in ("asc", "dsc"):
            kept.sort(key=lambda r: r[0].upper(), reverse=order == "dsc")  # keeps ties in input order
    else:
        kept.sort(key=lambda r: r[3], reverse=order.lower() == "dsc")
    kept = [r for r in kept if (not gt or r[3] > float(gt)) and (not lt or r[3] < float(lt))]
    assert rows(got, "country", "code", "year", "value") == kept[: None if limit is None else int(limit)]


@quick
@cases(
    st.lists(st.tuples(st.sampled_from("aAbB"), st.sampled_from([None, 1.0, 2.0])), min_size=1, max_size=8),
    st.sampled_from(["asc", "dsc"]),
)
def test_order_is_stable(spark, table, data, how):
    df = table("country string, value double", data).repartition(3)
    got = [r[0] for r in rows(order_rows(df, how, "name"), "_pos")]
    assert got == sorted(range(len(data)), key=lambda p: data[p][0].upper(), reverse=how == "dsc")


members = st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("xyz")), min_size=1, max_size=8)
lists = st.lists(st.sampled_from(["x", "X", "y", "z"]), max_size=4)
people = st.lists(st.tuples(st.sampled_from(["a", "A", "Turkey", "turkey", "b"]), codes, lists), min_size=1, max_size=5)


@quick
@cases(people, people, st.lists(st.tuples(st.sampled_from(["a", "B", "Turkey", "TURKEY", "", None]), codes), min_size=1, max_size=6))
def test_cities(spark, table, one, two, asked):
    cities = table("iso2 string, country string, cities array<string>", [(c, n, ls) for n, c, ls in one])
    nested = table(
        "name string, iso2 string, states array<struct<name:string,cities:array<struct<name:string>>>>",
        [(n, c, [("s", [(x,) for x in ls[:2]]), ("t", [(x,) for x in ls[2:]])]) for n, c, ls in two],
    )
    got = cities_of(
        table("req_id long, country string, iso2 string", [(i, *a) for i, a in enumerate(asked)], pos=False),
        cities.repartition(2), nested.repartition(2),
    )
    expected = []
    for i, (country, iso2) in enumerate(asked):
        hits = [None, None]
        for side, source in enumerate((one, two)):
            if country:
                hits[side] = first(source, lambda r: r[0].lower() == country.lower())
            if iso2:
                hits[side] = first(source, lambda r: r[1] is not None and fold(r[1]) == fold(iso2))
        if not (country or iso2):
            expected.append((i, 400, None))
        elif not any(hits):
            expected.append((i, 404, None))
        else:
            second = hits[1][2] if hits[1] and country != "Turkey" else []
            expected.append((i, 200, list(dict.fromkeys((hits[0][2] if hits[0] else []) + second))))
    assert rows(got.orderBy("req_id"), "req_id", "status", "cities") == expected


@quick
@cases(members, members)
def test_merge(spark, table, one, two):
    got = merge_members(table("e string, i string", one), table("e string, i string", two), "e", "i", ["q"])
    seen = {}
    for source, items in ((1, one), (2, two)):
        for p, (e, i) in enumerate(items):
            if not (source == 2 and e == "q"):
                seen.setdefault((e, i), (source, p))
    assert sorted(rows(got)) == sorted((*k, *v) for k, v in seen.items())
