import pytest
from compare import difference, views

from logloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    more, less, n = difference(spark, views(small), name, QUERIES[name], SQL[name], small)
    assert n and not more and not less
