import oracle
import pytest

from corpusmith.llm.queries import QUERIES
from corpusmith.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    oracle.assert_same(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, oracle.DIRECTORY).count() > 0
