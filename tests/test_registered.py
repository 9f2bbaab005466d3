"""Every registered query runs and agrees with its SQL on the smallest data folder."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
