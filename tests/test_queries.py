"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest
from loomhouse.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(DATA):
        connection.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    told = duck.execute(SQL[name])
    names = [c[0] for c in told.description]
    assert {c[0]: KINDS[str(c[1])] for c in told.description} == dict(frame.dtypes)
    order = sorted(names)
    want = sorted(repr([row[names.index(c)] for c in order]) for row in told.fetchall())
    got = sorted(repr([row[c] for c in order]) for row in frame.collect())
    assert got == want
