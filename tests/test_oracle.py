"""Every registered statement against DuckDB on the smallest test tables."""

import os

import pytest
from oracle_compare import differences, duck

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_statement(spark, connection, name):
    table = QUERIES[name](spark, SF).toArrow()
    assert differences(table, connection.execute(ORACLES[name]).to_arrow_table()) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 4
