"""Every registered query that has an oracle gives the same rows as its SQL."""

import pytest

from tests.oracle import spark_rows, sql_rows
from tracelake.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == sql_rows(ORACLE_SQL[name], DATA)


def test_noise_has_a_row_for_each_document(spark):
    rows = QUERIES["q_noise"](spark, DATA)
    assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert rows.where("n_values <> 49").isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["length_mod", "episodes", "successes", "mean_steps"]
