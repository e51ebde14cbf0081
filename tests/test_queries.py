import pytest

from swerve.plans import registry
from tests.compare import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(registry.ORACLES))
def test_against_sql(spark, duck, key):
    assert rows(registry.QUERIES[key](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLES[key]).df())


@pytest.mark.parametrize("key", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, key):
    assert registry.QUERIES[key](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
