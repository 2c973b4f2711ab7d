import pytest

from leafmill.queries import ORACLES, QUERIES

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
