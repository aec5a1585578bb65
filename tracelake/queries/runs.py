"""Whole runs: plan, execute, store, read back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import digests, ledger, store, table_function
from ..operators import metrics as M
from ..operators.runner import TrialSpec, run_plan
from ..operators.traces import cast_to
from ..plans import grid
from ..schemas import EPISODE_SCHEMA, STEP_SCHEMA
from ..session import ship
from ..sources.files import hadoop
from .plans import _tasks
from .registry import Register

register = Register()


class ClosedForm:
    """A trial whose trace follows from its plan row: 5 + task_id % 3 steps, a success if the task is even."""

    def run(self, row):
        length, task, base = 5 + row["task_id"] % 3, row["task_id"], len(row["instruction"]) % 7
        steps = []
        for k in range(length):
            t, done = k + 1, k + 1 >= length
            move = max(-1.0, min(1.0, 0.03 * t + 0.01 * base))
            steps.append(
                {
                    "frame_index": k, "timestamp": k / 20, "action": [move] * 6 + [1.0 if t % 2 else -1.0], "reward": float(done and task % 2 == 0), "next.done": done,
                    "observation.state": [0.1 * k, 0.2, 0.3, 0.0, 0.0, 0.0, 0.04 - 0.001 * k, -0.04], "observation.eef_position": [0.1 * t, 0.2, 0.3], "observation.gripper": math.nan,
                }
            )
        return {"success": task % 2 == 0, "reward": float(task % 2 == 0), "terminal_failure": None if task % 2 == 0 else "unlabeled", "steps": steps}


@register("""
SELECT CAST(p_partkey % 3 AS BIGINT) AS task_mod, count(*) AS episodes, CAST(sum(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS successes,
       avg(5 + p_partkey % 3) AS mean_steps FROM part GROUP BY 1""")
def q_resume_run(spark, sf_dir):
    """A run of all parts as tasks, in the bucket layout; a bucket of its steps is lost, the run is resumed, read back and measured.

    Only the episodes whose steps are gone are pending in the second run.
    """
    ship(spark)
    plan = grid.expand_grid(_tasks(spark, sf_dir).repartition("task_id"), "parts", "1", 1)  # the table has few files; all tasks make the plan
    out = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/runs/{uuid.uuid4().hex}"
    again = lambda: run_plan(plan, TrialSpec(ClosedForm, "closed-form", "1"), out, cohort_size=200_000, batch=64, layout="bucket")
    files, lost = hadoop(spark, f"{again().path}/steps/key_bucket=0")
    files.delete(lost, True)
    run = again()
    return M.metrics(run.episodes.withColumn("task_mod", F.col("task_id") % 3), "task_mod")


@register("""
SELECT CAST(p_partkey AS BIGINT) AS task_id, CAST(i AS BIGINT) AS frame_index, i = 4 + p_partkey % 3 AS done,
       round(CAST(CASE WHEN i = 4 + p_partkey % 3 AND p_partkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE), 6) AS reward
FROM part, range(7) r(i) WHERE i < 5 + p_partkey % 3""")
def q_trial_table(spark, sf_dir):
    """All parts as trials of a table function, its nested steps as rows."""
    plan = grid.expand_grid(_tasks(spark, sf_dir), "parts", "1", 1)
    traces = table_function.trials(plan, TrialSpec(ClosedForm, "closed-form", "1"), batch=64)
    steps = traces.select("task_id", F.explode("steps").alias("s"))
    return steps.select("task_id", "s.frame_index", F.col("s")["next.done"].alias("done"), F.round(F.col("s.reward").cast("double"), 6).alias("reward"))


@register("""
SELECT l_orderkey AS episode_key FROM lineitem GROUP BY l_orderkey
HAVING CASE WHEN l_orderkey % 7 = 0 THEN l_orderkey % 2 = 0 ELSE l_orderkey % 11 <> 3 OR count(*) = 1 END""")
def q_ledger_resume(spark, sf_dir):
    """Orders as episodes and their lines as steps, in buckets: of some a step is missing, of some the episode tells another length. The run is noted, and
    some get a second attempt, whose files are all that the ledger doesn't know; the orders that need no further one."""
    ship(spark)
    root = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/runs/{uuid.uuid4().hex}"
    key = F.col("l_orderkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(key.cast("string").alias("episode_key"), key.cast("string").alias("episode_id"), "l_orderkey", "l_linenumber")
    steps = lines.withColumn("frame_index", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).cast("long") - 1)
    episodes = lines.groupBy("episode_key", "episode_id", "l_orderkey").agg(F.count(F.lit(1)).alias("length"))
    wrong = F.when(key % 7 == 0, F.col("length") + 1).otherwise(F.col("length"))

    def write(steps, episodes, attempt):
        store.append_buckets(cast_to(_filled(steps, STEP_SCHEMA), STEP_SCHEMA), f"{root}/steps", attempt)
        store.append_buckets(cast_to(_filled(episodes, EPISODE_SCHEMA), EPISODE_SCHEMA), f"{root}/episodes", attempt)

    write(steps.where((key % 11 != 3) | (F.col("frame_index") != 1)), episodes.withColumn("length", wrong), 1)
    ledger.note(spark, root)
    write(steps.where(key % 14 == 0), episodes.where(key % 14 == 0), 2)
    return ledger.complete(spark, root, store.read_attempts).select(F.col("episode_key").cast("long").alias("episode_key"))


@register("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders),
b AS (SELECT k, CASE WHEN k % 401 = 7 THEN s || '!' ELSE s END AS s, p FROM a WHERE k % 997 <> 5 UNION ALL SELECT -k, s, p FROM a WHERE k % 1009 = 3),
gone AS (SELECT k, s, p FROM a EXCEPT SELECT k, s, p FROM b), come AS (SELECT k, s, p FROM b EXCEPT SELECT k, s, p FROM a)
SELECT k AS key, CAST(sum(r) AS BIGINT) AS n_removed, CAST(sum(c) AS BIGINT) AS n_added FROM (SELECT k, 1 AS r, 0 AS c FROM gone UNION ALL SELECT k, 0, 1 FROM come) GROUP BY k""")
def q_signature_diff(spark, sf_dir):
    """Two versions of the orders, of which some were changed, lost or added: the keys that differ, by their digest trees."""
    ship(spark)
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    changed = old.where("k % 997 <> 5").withColumn("s", F.when(F.col("k") % 401 == 7, F.concat("s", F.lit("!"))).otherwise(F.col("s")))
    new = changed.union(old.where("k % 1009 = 3").withColumn("k", -F.col("k")))
    root = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/trees/{uuid.uuid4().hex}"
    depth = digests.depth_for(old.count())
    digests.write_tree(old, "k", f"{root}/a", depth=depth)
    digests.write_tree(new, "k", f"{root}/b", depth=depth)
    return digests.differences(spark, f"{root}/a", f"{root}/b").keys.withColumn("key", F.col("key").cast("long"))


def _filled(frame, schema):
    """The schema's columns that the frame lacks, as nulls."""
    return frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in frame.columns})
