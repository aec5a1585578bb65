"""Trials by SQL, and functions that give several columns."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_runs import plan, spec
from tracelake.functions.batches import struct_of, with_structs
from tracelake.operators import table_function as T
from tracelake.operators.runner import execute


def rows_of(frame, names):
    return sorted(repr(r.asDict(recursive=True)) for r in frame.select(names).collect())


@pytest.mark.parametrize(("together", "batch", "parts"), [(False, 8, 3), (True, 2, 1)])
def test_traces_are_those_of_a_run(spark, together, batch, parts):
    rows = plan(spark).withColumn("seed", F.col("task_id") % 2 + 7)
    made = spec(together=together)
    plain = execute(rows.withColumn("episode_index", F.lit(0).cast("long")), made).drop("timing", "episode_index")
    found = T.trials(rows, made, parts=parts, batch=batch)
    assert found.columns == plain.columns and rows_of(found, plain.columns) == rows_of(plain, plain.columns)


def test_table_function_in_sql(spark):
    T.register(spark, "mock_trials", spec())
    plan(spark).createOrReplaceTempView("mock_plan")
    steps = spark.sql("SELECT task_id, s.frame_index, s.`next.done` AS done FROM (SELECT task_id, explode(steps) AS s FROM mock_trials(TABLE(mock_plan) PARTITION BY seed))")
    assert [tuple(r) for r in steps.groupBy("task_id").agg(F.count("*"), F.sum(F.col("done").cast("int"))).orderBy("task_id").collect()] == [(0, 10, 2), (1, 12, 2), (2, 14, 2)]
    with pytest.raises(Exception, match="lacks columns of a plan"):
        spark.sql("SELECT * FROM mock_trials(TABLE(SELECT seed FROM mock_plan) PARTITION BY seed)").collect()
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM mock_trials(1)").collect()
    assert spark.sql("SELECT * FROM mock_trials(TABLE(SELECT * FROM mock_plan WHERE false) PARTITION BY seed)").count() == 0


def sizes(a, b):
    return pd.DataFrame({"total": a + b, "rows": [len(a)] * len(a)})


def test_structs_are_unnested(spark):
    frame = spark.range(1000).select("id", (F.col("id") * 2).alias("b"), F.lit("old").alias("total"), F.lit(1).alias("_struct")).coalesce(1)
    found = with_structs(frame, sizes, "total long, rows int", ["id", F.col("b") + 1], batch=128)
    assert found.columns == ["id", "b", "_struct", "total", "rows"]
    assert [r["total"] for r in found.orderBy("id").collect()] == [3 * k + 1 for k in range(1000)]
    assert found.agg(F.max("rows"), F.min("rows")).first() == (128, 1000 % 128)
    assert with_structs(frame.where("false"), sizes, "total long, rows int", ["id", "b"]).count() == 0
    with pytest.raises(Exception, match="1 results of a batch of 128 rows"):
        frame.select(struct_of(lambda a: pd.DataFrame({"x": [1]}), "x int", "id")).collect()
    with pytest.raises(ValueError, match="positive"):
        struct_of(sizes, "x int", "id", batch=0)
