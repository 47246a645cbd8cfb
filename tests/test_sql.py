import pytest
from compare import difference, views

from logloom.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def db(small):
    return views(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, db, small, name):
    more, less, _ = difference(spark, db, name, QUERIES[name], SQL[name], small)
    assert not more and not less


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
