"""Queries with a SQL form against DuckDB."""

import duckdb
import pytest

from conftest import SMALL
from ticklane.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, SMALL)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)
