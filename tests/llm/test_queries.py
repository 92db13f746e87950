"""Queries of the subpackage that SQL can express, against it."""

import pytest

from scholium.llm import queries
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])
