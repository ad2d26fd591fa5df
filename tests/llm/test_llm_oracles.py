import pytest

from oracle import assert_same
from tessera.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)
