"""Every query over the event tables against its SQL counterpart in DuckDB."""

import pytest
from conftest import SF_DIR
from oracle_check import compare, connect

import __spark_entry__ as driver
from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLE) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = compare(QUERIES[name](spark, SF_DIR), tables, ORACLE[name])
    assert found > 0
