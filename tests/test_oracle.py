import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as driver
from tests import compare
from tests.conftest import DEFAULT_DATA as DATA
from trailtally.plans.oracle import ORACLE_SQL as ORACLES
from trailtally.plans.queries import QUERIES

# The optional queries have tests of their own.


@pytest.fixture(scope="module")
def connection(data):
    return compare.connect(data)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, connection, data, name):
    df = QUERIES[name](spark, data)
    columns, rows = compare.spark_rows(df)
    expected_columns, expected = compare.sql_rows(connection, ORACLES[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows or data != DATA
    assert compare.spark_types(df) == compare.sql_types(connection, ORACLES[name])


def test_entry(spark):
    assert driver.entry(spark).count() > 0
