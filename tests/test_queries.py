"""Every query of the library against its SQL; those without SQL must give rows."""

import pytest
from oracle import connect, same

from marginalia.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, con, name):
    same(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name])


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
