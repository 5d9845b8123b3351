"""Every registered query against its SQL statement."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kindred.plans.checks import all_queries
from kindred.plans.expected import SQL

FOLDER = os.environ.get("KINDRED_TEST_DATA", "/root/testdata/sf0.001")
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def test_every_query_has_a_statement():
    # Statements of the text operators, where SQL can express them, are held in a table of their own.
    own = set(all_queries())
    assert own == set(SQL)
    assert own <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, connection, name):
    expected = connection.sql(entry.oracle_sql()[name])
    columns = sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    places = [expected.columns.index(c) for c in columns]
    wanted = in_order([tuple(row[p] for p in places) for row in expected.fetchall()])
    got = in_order([tuple(row[c] for c in columns) for row in df.collect()])
    assert got == wanted
    assert got
