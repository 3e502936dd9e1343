"""Every registered query against its SQL, on the smallest driver tables."""

import os

import pytest
from compare import connect, duck_rows, spark_rows, type_gaps
from conftest import final_plan

import __spark_entry__ as driver
from driver_tables.oracle import SQL
from driver_tables.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    sql = SQL[name]
    assert type_gaps(df, con, sql) == {}
    assert spark_rows(df) == duck_rows(con, sql)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join_in_any_plan(spark, name):
    plan = final_plan(QUERIES[name](spark, SF))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_entry(spark):
    got = driver.entry(spark).collect()
    assert len(got) == 10 and [r.value for r in got] == sorted((r.value for r in got), reverse=True)


def test_sample(spark):
    sample = QUERIES["sample_rows"]
    assert sample(spark, SF).count() == 10 and sample(spark, SF).collect() == sample(spark, SF).collect()
