"""Loose number parsing, alike for call arguments and for text columns.

Rules: outer blanks are ignored; empty text is 0; decimal, exponent and
``Infinity`` forms are read, as are ``0x``/``0o``/``0b`` integers; anything else
is not a number.  "Not a number" is null here, never NaN, because Spark sorts
NaN above every value and would let ``5 <= NaN`` pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions.text import BLANKS, strip

# A cast alone would also read Java forms such as '1d', 'inf' and 'NaN'.
DECIMAL = r"^[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"
# Prefix letter -> (bits of a digit, digits, most digits that fit in 60 bits).
RADIX = {"x": (4, "0-9a-fA-F", 15), "o": (3, "0-7", 20), "b": (1, "01", 60)}


def number_arg(value: object) -> float | None:
    """A call argument as a float, or None when it is not a number."""
    if value is None:
        return None
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else float(value)
    text = str(value).strip(BLANKS)
    if text == "":
        return 0.0
    if re.match(DECIMAL, text):
        return float(text)
    base = RADIX.get(text[1:2].lower())
    if base and re.match(rf"^0[a-zA-Z][{base[1]}]+$", text):
        try:
            return float(int(text[2:], 2 ** base[0]))
        except OverflowError:
            return math.inf
    return None


def _radix_value(digits: Column, bits: int, most: int) -> Column:
    """Digits of ``bits`` bits each as a double, rounded once.

    The first 60 bits hold more than a double keeps; of the digits after them only
    their number matters, and whether one is not zero, which breaks ties.
    """
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    head = F.conv(F.substring(digits, 1, most), 2**bits, 10).cast("long")
    rest = F.substring(digits, F.lit(most + 1), F.length(digits))
    odd = F.when(rest.rlike("[^0]"), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return head.bitwiseOR(odd).cast("double") * F.pow(F.lit(2.0), bits * F.length(rest))


def _radix_reader(bits: int, most: int) -> Callable[[Column], Column]:
    return lambda digits: _radix_value(digits, bits, most)


def number_of_text(col: Column) -> Column:
    """A text column as double; null where the text is not a number.

    The stripped text is bound once; written out in each branch it would be worked out in each.
    """
    return bound(strip(col), _parsed)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once a row."""
    return F.transform(F.array(value), body)[0]


def _parsed(text: Column) -> Column:
    parsed = F.when(text == "", F.lit(0.0)).when(
        text.rlike(DECIMAL), text.try_cast("double")
    )
    for letter, (bits, digits, most) in RADIX.items():
        form = rf"^0[{letter}{letter.upper()}][{digits}]+$"
        digits_of = F.substring(text, F.lit(3), F.length(text))
        parsed = parsed.when(text.rlike(form), bound(digits_of, _radix_reader(bits, most)))
    return parsed


def number_column(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a number, by its type.

    A numeric column is used as it is, so that a comparison with it can be
    pushed to the file scan; see ``is_number`` for its NaN rows.
    """
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name)
    return number_of_text(F.col(name))


def is_number(df: DataFrame, name: str) -> Column:
    """False for the NaN rows of a float column, true otherwise."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return ~F.isnan(name)
    return F.lit(True)


def number_holds(df: DataFrame, name: str, test: Callable[[Column], Column]) -> Column:
    """Whether ``test`` holds for column ``name`` as a number; null or false for what is none.

    A numeric column is tested as it is, which the file scan can do; a text is parsed once.
    """
    number = number_column(df, name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return test(number) & is_number(df, name)
    return bound(number, test)
