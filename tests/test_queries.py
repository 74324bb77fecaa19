"""Every registered query against its SQL on the smallest driver tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload import fixtures

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def checker():
    connection = duckdb.connect()
    for name in fixtures.BASE:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, checker, name):
    result = QUERIES[name](spark, FOLDER)
    columns = sorted(result.columns)
    rows = sorted([plain(v) for v in row] for row in result.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    relation = checker.execute(ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted([plain(row[i]) for i in order] for row in relation.fetchall())
    assert rows == expected


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
