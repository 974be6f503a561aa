"""Every registered query against its DuckDB equivalent on the driver's tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages"):
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')"
        )
    return connection


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: [(value is None, str(value)) for value in row])


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLE.keys() <= contract.oracle_sql().keys()


def test_entry(spark):
    report = contract.entry(spark)
    assert report.columns == ["language", "files", "blank", "comment", "code"]
    assert report.count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR)
    cursor = duck.execute(contract.oracle_sql()[name])
    expected_names = [column[0] for column in cursor.description]
    assert sorted(result.columns) == sorted(expected_names)
    expected = sorted_rows(expected_names, cursor.fetchall())
    actual = sorted_rows(result.columns, [tuple(row) for row in result.collect()])
    assert expected
    assert len(actual) == len(expected)
    assert actual == expected
