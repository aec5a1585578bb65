"""Traces between nested and flat form, and their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import resolved, timestamp_of
from ..operators import metrics as M
from ..operators import traces as T
from .registry import Register, table

register = Register()


@register("""
SELECT conv_id, len(list(turn)) AS n_steps, string_agg(turn || ':' || role, ',' ORDER BY turn) AS steps FROM conversations GROUP BY conv_id""")
def q_nest_steps(spark, sf_dir):
    nested = T.nest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role"])
    text = F.array_join(F.transform("steps", lambda s: F.concat(s["turn"].cast("string"), F.lit(":"), s["role"])), ",")
    return nested.select("conv_id", F.size("steps").cast("long").alias("n_steps"), text.alias("steps"))


@register("SELECT conv_id, turn, role, text FROM conversations")
def q_explode_steps(spark, sf_dir):
    """Nested and flattened again: every step comes back."""
    return T.unnest(T.nest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["role", "text"]))


_PLACED = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events"


def _placed(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.row_number().over(order) - 1).cast("long").alias("frame_index"))


@register(f"""
WITH e AS ({_PLACED}), d AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN frame_index END) OVER (PARTITION BY user_id) AS first_done FROM e)
SELECT user_id, event_id, event_type, value, frame_index FROM d WHERE frame_index <= coalesce(first_done, 19) AND frame_index < 20""")
def q_truncate_done(spark, sf_dir):
    return M.until_done(_placed(spark, sf_dir), "user_id", "frame_index", F.col("event_type") == "purchase", 20)


@register(f"""
WITH e AS ({_PLACED})
SELECT user_id, frame_index, event_type, lead(value) OVER (PARTITION BY user_id ORDER BY frame_index) AS next_value FROM e""")
def q_prev_next_state(spark, sf_dir):
    return T.before_and_after(_placed(spark, sf_dir), "user_id", "frame_index", ["event_type"], ["value"])


@register(f"WITH e AS ({_PLACED}) SELECT user_id, frame_index, round(CAST(frame_index / 20.0 AS FLOAT), 4) AS timestamp FROM e")
def q_step_times(spark, sf_dir):
    return _placed(spark, sf_dir).select("user_id", "frame_index", F.round(timestamp_of(F.col("frame_index")), 4).alias("timestamp"))


@register("""
SELECT doc_id, coalesce(nullif(CASE WHEN quality = 1 THEN lang ELSE '' END, ''), source) AS task_name,
       CASE WHEN quality = 1 THEN NULL ELSE 'unlabeled' END AS terminal_failure FROM documents LEFT JOIN labels USING (doc_id)""")
def q_resolved_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    found = F.when(good, F.col("lang")).otherwise("")
    return rows.select("doc_id", resolved(found, F.col("source")).alias("task_name"), M.terminal_failure(good).alias("terminal_failure"))
