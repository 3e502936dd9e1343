"""Every text query with SQL against that SQL, and the registry."""

import pytest
from compare import connect, duck_rows, spark_rows, type_gaps

from terralog.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con, df = connect(SF), QUERIES[name](spark, SF)
    assert type_gaps(df, con, SQL[name]) == {}
    assert spark_rows(df) == duck_rows(con, SQL[name])
