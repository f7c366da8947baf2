"""Every registered query against its SQL, and the registration rules."""

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from oracle_compare import differences, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(key, spark, con):
    if key not in ORACLES:
        assert QUERIES[key](spark, SF_DIR).count() > 0
        return
    problem = differences(key, QUERIES[key], ORACLES[key], spark, con, SF_DIR)
    assert problem is None, problem


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert {"scope", "name", "examples"} <= set(df.columns)
    assert df.count() > 0
