import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from terralog import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        session.builder("tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def settings(spark):
    """Change session settings for one test."""
    before = {}

    def change(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def table(spark):
    """``table("a string, b int", rows)``; adds ``_pos`` in row order."""

    def make(schema, rows, pos=True):
        rows = [tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows]
        if pos:
            return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_pos long, {schema}")
        return spark.createDataFrame(rows, schema)

    return make


def rows(df, *columns):
    """Rows as tuples, in the order Spark returns them."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
