import oracle
import pytest

from chainlake.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    assert name in catalog.SQL
    assert oracle.same(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
