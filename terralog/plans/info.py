"""Country profiles with selectable columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.functions.args import parse_selectors
from terralog.names import POS
from terralog.operators.first_match import enrich_first

# Selector -> column of the master table, in output order.
FROM_MASTER = {
    "currency": "Currency",
    "unicodeFlag": "Unicode",
    "capital": "Capital",
    "dialCode": "Dial",
    "iso2": "Iso2",
    "iso3": "Iso3",
}
# Selector -> (key column there, value column there, key mode).
FROM_OTHERS = {
    "flag": ("name", "flag", "lower"),
    "cities": ("country", "cities", "exact"),
    "states": ("name", "states", "lower"),
}


def country_info(
    master: DataFrame,
    returns: str,
    flags: DataFrame | None = None,
    cities: DataFrame | None = None,
    states: DataFrame | None = None,
) -> DataFrame:
    """``name`` plus one column per selector named in ``returns``.

    Unknown selectors are ignored.  Empty text becomes null (absent in JSON
    output); blank text and empty lists stay.  A table is joined only if its
    selector is asked for, since Spark does not drop an unused outer join.
    """
    wanted = parse_selectors(returns)
    columns = [
        F.nullif(F.col(old), F.lit("")).alias(new) for new, old in FROM_MASTER.items() if new in wanted
    ]
    info = master.select(POS, F.col("Name").alias("name"), *columns)
    tables = {"flag": flags, "cities": cities, "states": states}
    for selector, (key, value, mode) in FROM_OTHERS.items():
        if selector not in wanted:
            continue
        if tables[selector] is None:
            raise ValueError(f"selector {selector!r} needs its table")
        info = enrich_first(info, tables[selector], "name", key, {selector: value}, mode)
    return info.withColumn("flag", F.nullif(F.col("flag"), F.lit(""))) if "flag" in wanted else info
