import oracle
import pytest

from chainlake.llm import registry


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, con, name):
    assert oracle.same(registry.queries()[name](spark, sf), con, registry.oracle_sql()[name])
