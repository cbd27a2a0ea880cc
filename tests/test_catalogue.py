import pytest
from compare import duck, same

from tidequery import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    same(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])
