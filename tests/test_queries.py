"""Every registered query against DuckDB on the same files."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from ticklane.plans.oracle import ORACLE_SQL
from ticklane.plans.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def _text(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert _sorted(frame.columns, frame.collect()) == _sorted(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 15
