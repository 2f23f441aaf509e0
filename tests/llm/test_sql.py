"""The queries that SQL can express against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from wattflow.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = con.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(relation.select(*columns).fetchall(), key=repr)
