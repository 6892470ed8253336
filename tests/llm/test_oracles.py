"""Queries against their SQL over whole tables."""

import pytest

from tests.oracles import same
from winnow.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, QUERIES[name], SQL[name]) == ""
