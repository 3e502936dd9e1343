"""Full-table views of the reference tables.

All keep ``_pos`` so that later operators can order or pick first matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.names import POS
from terralog.operators.first_match import enrich_first


def project(df: DataFrame, **columns: str) -> DataFrame:
    """``_pos`` plus ``new=old`` columns, in the order given."""
    return df.select(POS, *[F.col(old).alias(new) for new, old in columns.items()])


def positions(codes: DataFrame) -> DataFrame:
    return project(codes, name="name", iso2="iso2", long="longitude", lat="latitude")


def dial_codes(codes: DataFrame) -> DataFrame:
    return project(codes, name="name", code="code", dial_code="dial_code")


def currencies(master: DataFrame) -> DataFrame:
    return project(master, name="Name", currency="Currency", iso2="Iso2", iso3="Iso3")


def capitals(master: DataFrame) -> DataFrame:
    return project(master, name="Name", capital="Capital", iso2="Iso2", iso3="Iso3")


def unicode_flags(master: DataFrame) -> DataFrame:
    return project(master, name="Name", iso2="Iso2", iso3="Iso3", unicodeFlag="Unicode")


def flag_images(flags: DataFrame, master: DataFrame) -> DataFrame:
    """Flags with iso codes from the master, null where the name is unknown."""
    bare = project(flags, name="name", flag="flag")
    return enrich_first(bare, master, "name", "Name", {"iso2": "Iso2", "iso3": "Iso3"})


def iso_codes(flags: DataFrame, master: DataFrame) -> DataFrame:
    """Iso codes per flag row: the flags table decides which rows there are."""
    return project(flag_images(flags, master), name="name", Iso2="iso2", Iso3="iso3")


def countries_and_cities(cities: DataFrame, master: DataFrame) -> DataFrame:
    """City lists with iso codes; codes the list already carries are kept."""
    rich = enrich_first(cities, master, "country", "Name", {"iso2": "Iso2", "iso3": "Iso3"})
    return project(rich, iso2="iso2", iso3="iso3", country="country", cities="cities")


def country_states(states: DataFrame) -> DataFrame:
    """States per country; each state keeps its name and code only."""
    slim = F.transform("states", lambda s: F.struct(s["name"].alias("name"), s["state_code"].alias("state_code")))
    return states.select(POS, "name", "iso3", "iso2", slim.alias("states"))


def state_cities(nested: DataFrame) -> DataFrame:
    return project(nested, name="name", iso2="iso2", iso3="iso3", states="states")
