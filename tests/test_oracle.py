import pytest

from cairnlight.plans import catalogue
from tests.compare import same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, sf, name):
    same(spark, catalogue.QUERIES[name], catalogue.ORACLE[name], sf)


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
