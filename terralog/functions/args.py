"""Rules for call arguments.  Invalid ones raise ValueError on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralog.functions.numbers import number_arg
from terralog.functions.text import BLANKS
from terralog.names import MSG_INVALID_PAYLOAD, MSG_NEED_RETURNS


def is_given(value: object) -> bool:
    """None, False and '' mean "not given"; '0', 0 and ' ' are given."""
    return value is not None and value is not False and value != ""


def parse_limit(limit: object) -> int | None:
    """Rows to keep; None means all of them.

    Fractions are cut; zero, negative and non-numeric limits keep nothing.
    """
    if limit is None:
        return None
    if limit == "":
        raise ValueError(MSG_INVALID_PAYLOAD)
    number = number_arg(limit)
    if number is None or number < 1:
        return 0
    if math.isinf(number):
        return None
    return int(number)


def parse_selectors(returns: str | None) -> set[str]:
    """Column selectors from a comma list: trimmed, case kept."""
    if not returns:
        raise ValueError(MSG_NEED_RETURNS)
    return {part.strip(BLANKS) for part in returns.split(",")}


def bounds(col: Column, gt: object = None, lt: object = None) -> Column:
    """Strict bounds on a numeric column; a bound not given does not apply.

    A bound that is given but is no number matches nothing.
    """
    test = F.lit(True)
    for value, compare in ((gt, Column.__gt__), (lt, Column.__lt__)):
        if is_given(value):
            number = number_arg(value)
            test = test & (F.lit(False) if number is None else compare(col, F.lit(number)))
    return test
