"""Every query with SQL must give the same rows in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows(spark, database, name):
    sql = contract.oracle_sql()[name]
    assert compare(spark, database, contract.queries()[name], sql, FOLDER) == ""


def test_entry(spark):
    assert len(contract.entry(spark).take(1)) == 1
