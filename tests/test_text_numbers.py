import math

import pytest
from conftest import rows
from hypothesis import given as cases
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terralog.functions.args import bounds, is_given, parse_limit, parse_selectors
from terralog.functions.lists import flatten_cities, merge_lists
from terralog.functions.numbers import number_arg, number_of_text
from terralog.functions.text import BLANKS, contains_ignoring_case, given, message, norm_key, strip

DIRTY = ["  a ", " A ", "\ta\n", "﻿a", "　a ", "É", "a b", "", " ", None]


def test_strip_removes_every_blank_but_only_outside(table):
    got = rows(table("s string", DIRTY).select("s", strip(F.col("s")).alias("t")))
    assert got == [(s, None if s is None else s.strip(BLANKS)) for s in DIRTY]
    assert got[4][1] == "a" and got[6][1] == "a b"


def test_key_modes(table):
    names = [" Lagos State ", " Lagos ", "State", "ESTATE\t", None]
    df = table("s string", names)
    assert [r[0] for r in rows(df.select(norm_key(F.col("s"), "exact")))] == names
    assert [r[0] for r in rows(df.select(norm_key(F.col("s"), "lower")))] == [
        " lagos state ", " lagos ", "state", "estate\t", None,
    ]
    assert [r[0] for r in rows(df.select(norm_key(F.col("s"), "trim_lower")))] == [
        "lagos state", "lagos", "state", "estate", None,
    ]
    assert [r[0] for r in rows(df.select(norm_key(F.col("s"), "state")))] == [
        "lagos state", " lagos ", "state", "estate", None,
    ]
    with pytest.raises(ValueError):
        norm_key(F.col("s"), "fold")


def test_given_means_neither_absent_nor_empty(table):
    got = rows(table("s string", [None, "", " ", "0"]).select(given(F.col("s"))))
    assert [r[0] for r in got] == [False, False, True, True]
    assert [is_given(v) for v in (None, False, "", 0, "0", " ")] == [False, False, False, True, True, True]


def test_contains_takes_wildcards_literally(table):
    df = table("s string", ["100% Sure", "100 sure", "a_b", "acb"])
    assert rows(df.where(contains_ignoring_case(F.col("s"), "% s")), "s") == [("100% Sure",)]
    assert rows(df.where(contains_ignoring_case(F.col("s"), "A_B")), "s") == [("a_b",)]


def test_message_fields(table):
    df = table("a struct<n:string>, r struct<c:string>", [(("x",), (None,))])
    assert rows(df.select(message("{a.n} in {r.c}!"))) == [("x in !",)]


NUMBERS = {
    "": 0.0, " ": 0.0, " 1 ": 1.0, " 2.5\n": 2.5, "-.5": -0.5, "5.": 5.0, "1e3": 1000.0, "+7": 7.0,
    "0x10": 16.0, "0XfF": 255.0, "0o17": 15.0, "0b101": 5.0, "Infinity": math.inf, "-Infinity": -math.inf,
    "abc": None, "1d": None, "1f": None, "NaN": None, "inf": None, "-0x10": None, "1,5": None, ".": None,
    "1 2": None, "0x": None, "e5": None, None: None, "0x1234567890abcdef": float(0x1234567890ABCDEF),
    "0x" + "f" * 300: math.inf, "0x0000000000000000000001": 1.0, "0b" + "1" * 54: float(2**54 - 1),
    "0x20000000000001" + "0" * 20: float(0x20000000000001 << 80), "0x20000000000001" + "0" * 20 + "1": float((0x20000000000001 << 84) + 1),
    "0o" + "7" * 40: float(8**40 - 1), "0b1" + "0" * 80: float(2**80), "0x": None, "0o8": None,
}


def test_numbers_of_text_and_of_arguments_agree(table):
    got = rows(table("s string", list(NUMBERS)).select(number_of_text(F.col("s"))))
    assert [r[0] for r in got] == list(NUMBERS.values())
    assert [number_arg(s) for s in NUMBERS] == list(NUMBERS.values())


@cases(st.floats(allow_nan=False, allow_infinity=False) | st.integers(-(10**15), 10**15))
def test_number_arg_reads_what_python_prints(value):
    assert number_arg(str(value)) == float(value)


@pytest.mark.parametrize(
    "limit,expected",
    [
        (None, None), (0, 0), (1, 1), ("2.7", 2), ("-1", 0), ("abc", 0), (float("nan"), 0), ("Infinity", None),
        (" 3 ", 3), ("0x4", 4), (0.5, 0),
    ],
)
def test_limits(limit, expected):
    assert parse_limit(limit) == expected


def test_bad_limits_raise():
    with pytest.raises(ValueError, match="invalid payload format"):
        parse_limit("")
    assert parse_limit(2**40) == 2**40


def test_selectors():
    assert parse_selectors(" flag, iso2 ,x") == {"flag", "iso2", "x"}
    assert parse_selectors("  ") == {""}
    for nothing in ("", None):
        with pytest.raises(ValueError):
            parse_selectors(nothing)


@pytest.mark.parametrize(
    "gt,lt,expected",
    [
        (None, None, [-1.0, 0.0, 5.0, 9.0]), ("", False, [-1.0, 0.0, 5.0, 9.0]), ("0", None, [5.0, 9.0]),
        (0, None, [5.0, 9.0]), (None, "5", [-1.0, 0.0]), ("-1", "9", [0.0, 5.0]), ("x", None, []), ("", "0x5", [-1.0, 0.0]),
    ],
)
def test_bounds(table, gt, lt, expected):
    df = table("v double", [-1.0, 0.0, 5.0, 9.0, None])
    kept = [r[0] for r in rows(df.where(bounds(F.col("v"), gt, lt)), "v")]
    assert [v for v in kept if v is not None] == expected


def test_merge_lists_keeps_first_occurrences(table):
    df = table(
        "a array<string>, b array<string>",
        [(["x", "y", "x"], ["Y", "y", "z"]), (None, ["a"]), (["a", "a"], None), (None, None), ([], [])],
    )
    got = [r[0] for r in rows(df.select(merge_lists(F.col("a"), F.col("b"))))]
    assert got == [["x", "y", "Y", "z"], ["a"], ["a"], [], []]


def test_flatten_cities_survives_nulls(table):
    df = table(
        "s array<struct<name:string,cities:array<struct<name:string>>>>",
        [([("p", [("a",), ("b",)]), ("q", None), ("r", []), ("s", [("a",)])],), (None,), ([],)],
    )
    assert [r[0] for r in rows(df.select(flatten_cities(F.col("s"))))] == [["a", "b", "a"], [], []]
