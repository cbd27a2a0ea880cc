import pytest
from compare import duck, same

from tidequery.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert same(catalog.queries()[name](spark, SF), duck(SF), catalog.oracle_sql()[name]) > 0
