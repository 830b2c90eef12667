"""Queries that SQL can express, over whole tables, against that SQL."""

import pytest
from compare import database, difference

from quillstone.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_its_sql(name, spark, tiny):
    assert difference(QUERIES[name](spark, tiny), database(tiny), ORACLE_SQL[name]) is None
