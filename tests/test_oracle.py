import pytest

from labelwright.plans import catalog

from .oracle import compared, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_same_as_sql(spark, con, name):
    got, want = compared(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_an_oracle():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
