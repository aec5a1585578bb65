"""Queries that SQL can express give the same rows as their SQL."""

import pytest

from tests.oracle import spark_rows, sql_rows
from tracelake.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == sql_rows(ORACLE_SQL[name], DATA)
