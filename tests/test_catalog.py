import pytest

from labelgrid.catalog import ORACLES, QUERIES
from oracle import connect, same

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])
