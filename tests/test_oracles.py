import oracle
import pytest

from evisparq.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    oracle.compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_queries_without_sql_have_tests():
    import test_without_sql

    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {x.removeprefix("test_") for x in dir(test_without_sql) if x.startswith("test_")}
