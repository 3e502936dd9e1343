"""Explicit schemas; nothing is inferred.

Columns that hold numbers and text side by side are read as text and turned
into numbers by ``functions.numbers``.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# Field names of the input tables.
CODES = T.StructType(_strings("name", "dial_code", "iso2", "code", "latitude", "longitude"))
FLAGS = T.StructType(_strings("name", "flag", "number"))
MASTER = T.StructType(_strings("Iso2", "Name", "Iso3", "Unicode", "Dial", "Currency", "Capital", "Continent"))
STATE = T.StructType(_strings("id", "name", "state_code"))
STATES = T.StructType(
    [
        *_strings("name", "iso3", "iso2", "phone_code", "capital", "currency"),
        T.StructField("states", T.ArrayType(STATE)),
    ]
)
CITIES = T.StructType([*_strings("country"), T.StructField("cities", T.ArrayType(T.StringType()))])
CITY = T.StructType(_strings("name"))
STATE_WITH_CITIES = T.StructType([*_strings("name"), T.StructField("cities", T.ArrayType(CITY))])
STATE_CITIES = T.StructType(
    [*_strings("name", "iso2", "iso3"), T.StructField("states", T.ArrayType(STATE_WITH_CITIES))]
)
COUNTRY_POPULATION = T.StructType(_strings("Country Name", "Country Code", "Year", "Value"))
CITY_POPULATION = T.StructType(_strings("City", "Country or Area", "Year", "Value", "Sex", "Reliability"))
REQUESTS = T.StructType(
    [T.StructField("req_id", T.LongType()), *_strings("country", "iso2", "iso3", "city", "state")]
)
ACCESS_EVENTS = T.StructType([T.StructField("ts", T.TimestampType()), *_strings("client")])
