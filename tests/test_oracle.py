"""Every query against the same query as SQL."""

import pytest
from conftest import SF
from oracle_compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry_points
from coinbrook.checks.oracle import ORACLE_SQL
from coinbrook.checks.queries import QUERIES


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, connection, name):
    got = spark_rows(entry_points.queries()[name](spark, SF))
    want = duck_rows(connection, entry_points.oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "a query without rows proves nothing"


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5
