"""Text keys: trimming, case folding and message templates."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters stripped from both ends of a key.  Spark's own
# trim() strips U+0020 only.
BLANKS = (
    "\t\n\x0b\x0c\r\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

KEY_MODES = ("exact", "lower", "trim_lower", "state")


def strip(col: Column) -> Column:
    """Remove blanks (any Unicode blank and the BOM) from both ends."""
    return F.btrim(col, F.lit(BLANKS))


def norm_key(col: Column, mode: str) -> Column:
    """The comparison key of a text column.

    The modes differ between operators on purpose.  ``state`` trims a name only
    when it ends in "state"; every other name keeps its outer blanks.
    """
    if mode == "exact":
        return col
    if mode == "lower":
        return F.lower(col)
    trimmed = F.lower(strip(col))
    if mode == "trim_lower":
        return trimmed
    if mode == "state":
        return F.when(trimmed.endswith("state"), trimmed).otherwise(F.lower(col))
    raise ValueError(f"unknown key mode {mode!r}; expected one of {KEY_MODES}")


def given(col: Column) -> Column:
    """A request field counts as given unless it is absent or empty.

    Blank text such as ``' '`` is given.
    """
    return F.coalesce(col, F.lit("")) != ""


def contains_ignoring_case(col: Column, part: str) -> Column:
    """Case-blind substring test; ``%`` and ``_`` have no special meaning."""
    return F.lower(col).contains(F.lower(F.lit(part)))


def message(template: str) -> Column:
    """Turn ``"cities in {answer.name}"`` into a string expression.

    Null fields render as nothing, so a message is never null.
    """
    pieces: list[Column] = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if field:
            pieces.append(F.coalesce(F.col(field), F.lit("")))
    return F.concat(*pieces)
