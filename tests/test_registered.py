"""Every registered query runs on the smallest tables, and gives what its SQL gives."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as registered
import check

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = registered.queries(), registered.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in check.TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
    assert all(re.match(r"op\d+_|pipeline$", name) for name in set(QUERIES) - set(ORACLE))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, base, name):
    df = QUERIES[name](spark, FOLDER)
    got, columns = check.rows_of(df.columns, df.collect())
    if name in ORACLE:
        result = base.execute(ORACLE[name])
        want, want_columns = check.rows_of([c[0] for c in result.description], result.fetchall())
        assert columns == want_columns
        assert got == want


def test_entry(spark):
    assert registered.entry(spark).columns == ["source_path", "archive_path", "stub_text"]
