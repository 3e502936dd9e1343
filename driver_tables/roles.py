"""The driver tables in the shape the operators expect.

Customers play countries (positions, codes, currencies), suppliers flags, parts
and orders yearly facts, documents nested lists of states (lines) and cities
(words).  All rows of a table are used.  Some keys are made blank, unknown,
padded or upper case, by columns of the table, to reach every branch.
``oracle.py`` states the same roles in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralog.names import POS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_name(key: str | Column) -> Column:
    number = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("Customer#"), F.lpad(number.cast("string"), 9, "0"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a latitude in text, some of it no number."""
    nation = F.col("c_nationkey").cast("string")
    kind = F.col("c_nationkey") % 6
    latitude = (
        F.when(kind == 0, "")
        .when(kind == 1, "abc")
        .when(kind == 2, F.concat(F.lit(" "), nation, F.lit("\t")))
        .when(kind == 3, "0x10")
        .when(kind == 5, F.concat(nation, F.lit(".5")))
    )
    iso2 = F.concat(F.lit("C-"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(POS),
        F.col("c_name").alias("name"),
        F.concat(F.lit("+"), nation).alias("dial_code"),
        iso2.alias("iso2"),
        iso2.alias("code"),
        latitude.alias("latitude"),
        F.col("c_acctbal").alias("longitude"),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with currency, capital and so on, some of it empty or blank."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(POS),
        F.concat(F.lit("C-"), key).alias("Iso2"),
        F.col("c_name").alias("Name"),
        F.concat(F.lit("CUS"), key).alias("Iso3"),
        F.concat(F.lit("U+"), nation).alias("Unicode"),
        F.when(F.col("c_nationkey") == 0, "")
        .when(F.col("c_nationkey") == 1, " ")
        .otherwise(F.concat(F.lit("+"), nation))
        .alias("Dial"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("Currency"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.concat(F.lit("Capital "), nation)).alias("Capital"),
        F.col("c_mktsegment").alias("Continent"),
    )


def part_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by name: few names, many rows each."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(POS),
        F.col("p_name").alias("Name"),
        F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("Iso2"),
        F.col("p_brand").alias("Iso3"),
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as flags of every twentieth customer, some names padded, some unknown."""
    name = customer_name(F.col("s_suppkey") * 20)
    padded = F.concat(F.lit(" "), F.upper(name), F.lit(" "))
    number = F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("https://flags.example/"), number, F.lit(".svg"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias(POS),
        F.when(F.col("s_nationkey") < 12, padded).otherwise(F.lower(name)).alias("name"),
        F.when(F.col("s_nationkey") == 13, "").otherwise(url).alias("flag"),
        number.alias("number"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests by customer name and iso2."""
    name = customer_name("o_custkey")
    level = F.col("o_orderpriority")
    country = (
        F.when(level == "1-URGENT", "")
        .when(level == "3-MEDIUM", F.concat(F.lit("\t"), F.upper(name), F.lit(" ")))
        .when(level == "4-NOT SPECIFIED", "Nowhere")
        .when(level == "5-LOW", name)
    )
    iso2 = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" c-"), F.col("o_custkey").cast("string")))
        .when(F.col("o_orderstatus") == "O", "")
        .when(level == "5-LOW", "zz")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("req_id"), country.alias("country"), iso2.alias("iso2")
    )


def series_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per customer, by name or iso3, for that customer's own series."""
    name = F.col("c_name")
    segment = F.col("c_mktsegment")
    country = (
        F.when(segment == "BUILDING", "")
        .when(segment == "HOUSEHOLD", F.concat(F.lit("\t"), F.upper(name), F.lit(" ")))
        .when(segment == "FURNITURE", "Nowhere")
        .when(segment == "AUTOMOBILE", name)
    )
    kind = F.col("c_nationkey") % 3
    iso3 = (
        F.when(kind == 0, F.concat(F.lit(" c-"), F.col("c_custkey").cast("string")))
        .when(kind == 1, "")
        .when(segment == "AUTOMOBILE", "zz")
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("req_id"), country.alias("country"), iso3.alias("iso3"), country.alias("city")
    )


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one yearly fact of its customer."""
    name = customer_name("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(POS),
        name.alias("country"),
        F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("code"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("value"),
    )


def order_city_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(POS),
        customer_name("o_custkey").alias("city"),
        F.col("o_orderpriority").alias("country"),
        F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderstatus").alias("sex"),
        F.concat(F.lit("R"), F.col("o_orderpriority")).alias("reliabilty"),
    )


def part_city_facts(spark: SparkSession, sf_dir: str, null_name: str | None = None) -> DataFrame:
    """Parts as city facts: same-named cities under many countries."""
    name = F.col("p_name")
    city = F.when(name != null_name, name) if null_name else name
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(POS),
        city.alias("city"),
        F.col("p_brand").alias("country"),
        F.col("p_size").alias("year"),
        F.col("p_retailprice").alias("value"),
        F.col("p_type").alias("sex"),
        F.concat(F.lit("R"), F.col("p_type")).alias("reliabilty"),
    )


def nation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals per nation and year.

    Amounts are added as decimals, so the sum does not depend on task order.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    totals = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "year")
        .agg(F.sum("price").alias("value"))
    )
    return totals.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (F.col("n_nationkey") * 10000 + F.col("year")).cast("long").alias(POS),
        F.col("n_name").alias("country"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"),
        "year",
        F.col("value").cast("double").alias("value"),
    )


def doc_name() -> Column:
    return F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))


def doc_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as countries whose cities are their lines."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(POS), doc_name().alias("country"), F.split("text", "\n").alias("cities")
    )


def doc_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as the master of the documents they cover."""
    number = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias(POS),
        F.concat(F.lit(" DOC "), number, F.lit("\t")).alias("Name"),
        F.concat(F.lit("D-"), number).alias("Iso2"),
        F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("Iso3"),
    )


def doc_state_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as countries, lines as states, words as cities."""

    def state(line: Column, i: Column) -> Column:
        number = i.cast("string")
        name = F.when(i % 2 == 0, F.concat(F.lit("  Line "), number, F.lit(" State "))).otherwise(
            F.concat(F.lit("Line "), number)
        )
        words = F.arrays_zip(F.split(line, " ")).cast("array<struct<name:string>>")
        return F.struct(name.alias("name"), words.alias("cities"))

    number = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(POS),
        doc_name().alias("name"),
        F.concat(F.lit("D-"), number).alias("iso2"),
        F.col("lang").alias("iso3"),
        F.transform(F.split("text", "\n"), state).alias("states"),
    )


def doc_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as countries with their lines as states."""

    def state(line: Column, i: Column) -> Column:
        number = i.cast("string")
        return F.struct(
            number.alias("id"),
            line.alias("name"),
            F.when(line != "", F.concat(F.lit("L"), number)).alias("state_code"),
        )

    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(POS),
        doc_name().alias("name"),
        F.col("lang").alias("iso3"),
        F.concat(F.lit("D-"), F.col("doc_id").cast("string")).alias("iso2"),
        F.col("source").alias("phone_code"),
        F.transform(F.split("text", "\n"), state).alias("states"),
    )


def doc_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per document, by name, iso2 or both, and a line as state."""
    number = F.col("doc_id").cast("string")
    lang, source = F.col("lang"), F.col("source")
    country = (
        F.when(lang == "de", "")
        .when(lang == "en", F.upper(doc_name()))
        .when(source == "src0", F.concat(doc_name(), F.lit(" ")))
        .when(source == "src1", "Nowhere")
        .otherwise(doc_name())
    )
    iso2 = F.when(lang == "fr", F.concat(F.lit(" d-"), number)).when(
        (lang == "es") & (source == "src2"), "zz"
    )
    state = (
        F.when(source == "src3", "")
        .when(source == "src4", "LINE 1")
        .when(source == "src5", "line 0")
        .otherwise("Line 0 STATE")
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("req_id"), country.alias("country"), iso2.alias("iso2"), state.alias("state")
    )


def place_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per nation, as state of its region, and one miss of each kind per region.

    Each nation's members are asked for once, so the answer is as long as the
    member table.
    """
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    per_nation = (
        table(spark, sf_dir, "nation")
        .join(region, "n_regionkey")
        .select(
            F.col("n_nationkey").cast("long").alias("req_id"),
            F.lower("r_name").alias("country"),
            F.lower("n_name").alias("state"),
        )
    )

    def miss(base: int, country: Column, state: Column) -> DataFrame:
        return region.select(
            (F.lit(base) + F.col("n_regionkey")).cast("long").alias("req_id"),
            country.alias("country"),
            state.alias("state"),
        )

    return (
        per_nation.unionByName(miss(1000, F.lit(""), F.lit("x")))
        .unionByName(miss(2000, F.col("r_name"), F.lit(None).cast("string")))
        .unionByName(miss(3000, F.concat("r_name", F.lit(" ")), F.lit("nation_0")))
        .unionByName(miss(4000, F.col("r_name"), F.lit("nation_99")))
    )
