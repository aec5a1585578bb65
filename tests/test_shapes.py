"""Physical plans that must stay as they are."""

from pyspark.sql import functions as F

from tracelake.operators import metrics as M
from tracelake.plans.grid import expand_grid
from tracelake.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pending_is_an_anti_join(spark):
    assert "LeftAnti" in physical(QUERIES["q_pending"](spark, DATA))


def test_metrics_is_one_exchange_and_prunes(spark):
    plan = physical(M.metrics(spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("episode_key"), F.lit(True).alias("success"), F.col("n_chars").alias("length"), "lang"), "lang"))
    assert plan.count("Exchange") == 1 and "text" not in plan


def test_completeness_is_one_exchange_without_distinct(spark):
    steps = spark.read.parquet(f"{DATA}/lineitem.parquet").select(F.col("l_orderkey").alias("episode_key"), (F.col("l_linenumber") - 1).alias("frame_index"), "l_shipdate")
    plan = physical(M.contiguous(steps))
    assert plan.count("Exchange") == 1 and "distinct" not in plan.lower().replace("n_distinct", "") and "l_shipdate" not in plan


def test_bitmaps_tell_gaps_doubles_and_long_keys(spark):
    frames = {"ok": range(70_000), "gap": [*range(40_000), *range(40_001, 70_000)], "double": [*range(39_999), 39_998], "late": range(1, 5), "low": range(-1, 3), "swap": [0, 1, 1, 3], "one": [0], "null": [0, 1, None]}
    rows = spark.createDataFrame([(k, f) for k, own in frames.items() for f in own], "episode_key string, frame_index long")
    assert dict(map(tuple, M.contiguous(rows).collect())) == {"ok": 70_000, "one": 1, "null": 2}
    assert dict(map(tuple, M.contiguous(rows, first=1).collect())) == {"late": 4}


def test_grid_has_no_join(spark):
    tasks = spark.range(3).selectExpr("'s' suite", "'v' suite_variant", "'p' perturbation", "id task_id", "string(id) task_key", "'n' task_name", "'i' instruction", "'b' bddl_path", "'t' init_path")
    plan = physical(expand_grid(tasks, "b", "r", 3))
    assert "Join" not in plan and "Exchange" not in plan


def test_small_lookups_are_broadcast(spark):
    plan = physical(QUERIES["q_fallback_pair"](spark, DATA))
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan


def test_no_single_partition_outside_global_results(spark):
    for name in ("q_trace_metrics", "q_complete_dirty", "q_nest_steps", "q_truncate_done", "q_fallback_pair", "q_signature"):
        assert "SinglePartition" not in physical(QUERIES[name](spark, DATA)), name
