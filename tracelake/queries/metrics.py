"""Completeness, rollups and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.signature import group_signature
from .registry import Register, table

register = Register()


@register("""
WITH whole AS (
  SELECT conv_id, count(turn) AS length, arg_max(role, turn) AS last_role
  FROM conversations GROUP BY conv_id
  HAVING min(turn) = 0 AND max(turn) = count(turn) - 1 AND count(DISTINCT turn) = count(turn))
SELECT length % 3 AS length_mod, count(*) AS episodes,
       CAST(sum(CASE WHEN last_role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS successes, avg(length) AS mean_steps
FROM whole GROUP BY 1""")
def q_trace_metrics(spark, sf_dir):
    """Steps to complete episodes to metrics by group: a conversation succeeds if the assistant has the last word."""
    steps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_key"), F.col("turn").alias("frame_index"), "role")
    ends = steps.groupBy("episode_key").agg(F.max_by("role", "frame_index").alias("last_role"))
    episodes = M.contiguous(steps).withColumnRenamed("n_rows", "length").join(ends, "episode_key")
    return M.metrics(episodes.withColumns({"success": F.col("last_role") == "assistant", "length_mod": F.col("length") % 3}), "length_mod")


@register("""
SELECT lang, count(doc_id) AS episodes, CAST(sum(quality) AS BIGINT) AS successes, avg(n_chars) AS mean_steps
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def q_metrics_grouped(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    episodes = joined.select(F.col("doc_id").alias("episode_key"), "lang", (F.col("quality") == 1).alias("success"), F.col("n_chars").alias("length"))
    return M.metrics(episodes, "lang")


@register("SELECT toxic, coalesce(sum(quality), 0) / CAST(count(doc_id) AS DOUBLE) AS success_rate FROM labels GROUP BY toxic")
def q_success_rate(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("episode_key"), "toxic", (F.col("quality") == 1).alias("success"), F.lit(1).alias("length"))
    return M.success_rate(labels, "toxic")


@register("""
SELECT conv_id, count(turn) AS n_rows FROM conversations GROUP BY conv_id
HAVING min(turn) = 0 AND max(turn) = count(turn) - 1 AND count(DISTINCT turn) = count(turn)""")
def q_complete_episodes(spark, sf_dir):
    return M.contiguous(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@register("""
SELECT l_orderkey, count(l_linenumber) AS n_rows FROM lineitem GROUP BY l_orderkey
HAVING min(l_linenumber) = 1 AND max(l_linenumber) = count(l_linenumber) AND count(DISTINCT l_linenumber) = count(l_linenumber)""")
def q_complete_dirty(spark, sf_dir):
    """Most orders have gaps or doubles; lines count from 1."""
    return M.contiguous(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", first=1)


@register("""
WITH whole AS (
  SELECT l_orderkey, count(l_linenumber) AS n_rows FROM lineitem GROUP BY l_orderkey
  HAVING min(l_linenumber) = 1 AND max(l_linenumber) = count(l_linenumber) AND count(DISTINCT l_linenumber) = count(l_linenumber))
SELECT DISTINCT o_orderkey AS episode_key FROM orders JOIN whole ON o_orderkey = l_orderkey WHERE o_orderkey % 3 + 1 = n_rows""")
def q_complete_vs_length(spark, sf_dir):
    """Orders whose lines are complete and as many as the order says (here by its key)."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_key"), (F.col("l_linenumber") - 1).alias("frame_index"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_key"), (F.col("o_orderkey") % 3 + 1).alias("length"))
    return M.complete_keys(orders, steps)


@register("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_pending(spark, sf_dir):
    return M.pending(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@register("""
SELECT user_id, count(*) AS length, arg_max(value, event_id) AS reward, bool_or(event_type = 'purchase') AS done
FROM events GROUP BY user_id""")
def q_episode_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("done", F.col("event_type") == "purchase")
    return M.rollup(events, "user_id", "event_id", "value", "done")


@register("""
SELECT d.doc_id, lang, source, n_chars FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0""")
def q_failure_steps(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("success"))
    return M.failures(labels, table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@register("""
WITH c AS (
  SELECT l_returnflag, l_extendedprice / 1000 AS wall, l_tax AS reset, l_discount AS settle, l_tax + l_discount AS policy,
         l_quantity / 100 AS environment, l_linenumber AS transitions FROM lineitem),
s AS (
  SELECT l_returnflag, count(*) AS cohorts, sum(wall) AS w, sum(reset) AS r, sum(settle) AS s, sum(policy) AS p, sum(environment) AS e,
         CAST(sum(transitions) AS BIGINT) AS transitions FROM c GROUP BY 1)
SELECT l_returnflag, cohorts, transitions, round(w, 4) AS wall_seconds, round(p, 4) AS policy_seconds,
       round(greatest(0, w - r - s - p - e), 4) AS other_seconds, round(transitions / nullif(w, 0), 6) AS transitions_per_second FROM s""")
def q_timing_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_extendedprice") / 1000).alias("wall_seconds"), F.col("l_tax").alias("reset_seconds"), F.col("l_discount").alias("settle_seconds"),
        (F.col("l_tax") + F.col("l_discount")).alias("policy_seconds"), (F.col("l_quantity") / 100).alias("environment_seconds"),
        F.col("l_linenumber").cast("long").alias("transitions"), F.lit(None).cast("string").alias("batch_fallback"),
    )
    rolled = M.timing_rollup(lines, "l_returnflag")
    rounded = [F.round(c, 4).alias(c) for c in ("wall_seconds", "policy_seconds", "other_seconds")]
    return rolled.select("l_returnflag", "cohorts", "transitions", *rounded, F.round("transitions_per_second", 6).alias("transitions_per_second"))


@register("""
SELECT conv_id, count(*) AS n_rows,
       sha256(string_agg(sha256('{"role":"' || role || '","text_sha256":"' || sha256(text) || '","turn":' || turn || '}'), chr(10) ORDER BY turn)) AS content_hash
FROM conversations GROUP BY conv_id""")
def q_signature(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("text_sha256", F.sha2("text", 256))
    return group_signature(turns, "conv_id", "turn", ["role", "text_sha256", "turn"])


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@register("SELECT DISTINCT l_orderkey FROM lineitem")
def q_distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
