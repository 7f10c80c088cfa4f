"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as contract
from tools.compare import compare, connect

SQLS = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_twin_has_a_query():
    assert set(SQLS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_equals_sql(spark, con, sf, name):
    ok, rows, message = compare(spark, con, sf, name, QUERIES[name], SQLS[name])
    assert ok and rows > 0, message
