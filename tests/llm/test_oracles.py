"""The corpus queries that have SQL, against DuckDB at the smallest scale."""

import pytest

from cladeframe.llm import queries, sql
from tests.llm.conftest import SF
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), sql.oracle_sql()[name])
