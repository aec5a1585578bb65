"""Counts, rates and rollups of episodes and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(episodes: DataFrame, *group_by: str) -> DataFrame:
    """Episodes, successes and mean steps, overall or by group: one partial and one final aggregate."""
    totals = [
        F.count("episode_key").alias("episodes"),
        F.sum(F.col("success").cast("long")).alias("successes"),
        F.avg("length").alias("mean_steps"),
    ]
    return episodes.groupBy(*group_by).agg(*totals)


def success_rate(episodes: DataFrame, *group_by: str) -> DataFrame:
    """Successes over episodes; NaN without episodes, and a null count of successes is 0."""
    counted = metrics(episodes, *group_by)
    rate = F.when(F.col("episodes") > 0, F.coalesce("successes", F.lit(0)) / F.col("episodes")).otherwise(F.lit(float("nan")))
    return counted.select(*group_by, rate.cast("double").alias("success_rate"))


def frame_checks(steps: DataFrame, *keys: str, frame: str = "frame_index", deal: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n_rows, lo, hi, n_distinct) of the frames of each key that aren't null.

    Rows are dealt once, by the keys or those of them in ``deal``. Each 64 consecutive frames of a key are one word of bits, whose ones are added up by key: hash
    aggregates of numbers alone, so neither distinct frames nor a group is ever held in memory or dealt again.
    """
    number = steps.select(*keys, F.col(frame).cast("long").alias("_frame")).where("_frame is not null").repartition(*(deal or keys))
    bit = F.expr("shiftleft(1L, cast(pmod(_frame, 64) as int))")
    words = number.groupBy(*keys, F.expr("(_frame - pmod(_frame, 64)) div 64").alias("_word")).agg(
        F.count("_frame").alias("n_rows"), F.min("_frame").alias("lo"), F.max("_frame").alias("hi"), F.bit_count(F.bit_or(bit)).cast("long").alias("n_distinct")
    )
    return words.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n_distinct").alias("n_distinct"))


def gapless(first: int = 0) -> Column:
    """Whether frame_checks() tells frames from ``first`` on without a gap or a double."""
    return (F.col("lo") == first) & (F.col("hi") == F.col("n_rows") - 1 + first) & (F.col("n_distinct") == F.col("n_rows"))


def contiguous(steps: DataFrame, key: str = "episode_key", frame: str = "frame_index", first: int = 0) -> DataFrame:
    """(key, n_rows) of keys whose frames run from ``first`` on without a gap or a double."""
    return frame_checks(steps, key, frame=frame).where(gapless(first)).select(key, "n_rows")


def complete_keys(episodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Keys of episodes whose steps are contiguous and as many as the episode says."""
    good = contiguous(steps)
    return episodes.join(good, "episode_key").where(F.col("length") == F.col("n_rows")).select("episode_key").distinct()


def pending(plan: DataFrame, completed: DataFrame, key: str = "episode_key") -> DataFrame:
    """Plan rows without a completed key; rows with a null key stay pending."""
    return plan.join(completed, key, "left_anti")


def rollup(steps: DataFrame, key: str = "episode_key", frame: str = "frame_index", reward: str = "reward", done: str = "`next.done`") -> DataFrame:
    """Per episode: length, the last reward, and whether it was ever done."""
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("length"), F.max_by(reward, frame).alias("reward"), F.max(done).alias("done"))


def terminal_failure(success: Column) -> Column:
    """No label for a success, "unlabeled" for a failure; success is told by the runtime, not by a step being done."""
    return F.when(success, F.lit(None).cast("string")).otherwise("unlabeled")


def failures(episodes: DataFrame, steps: DataFrame, key: str = "episode_key") -> DataFrame:
    """Steps of failed episodes."""
    return steps.join(episodes.where(~F.col("success")).select(key), key)


def until_done(steps: DataFrame, key: str, order: str, done: Column, max_steps: int) -> DataFrame:
    """Steps up to and with the first that is done, and below ``max_steps``; ``order`` counts from 0."""
    first = F.min(F.when(done, F.col(order))).over(Window.partitionBy(key))
    return steps.withColumn("first_done", first).where((F.col(order) <= F.coalesce("first_done", F.lit(max_steps - 1))) & (F.col(order) < max_steps)).drop("first_done")


def timing_rollup(cohorts: DataFrame, *group_by: str) -> DataFrame:
    """Sums of the phases; what the wall time has besides them (never below 0); transitions a second (null without wall time)."""
    phases = ("reset_seconds", "settle_seconds", "policy_seconds", "environment_seconds")
    summed = cohorts.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("cohorts"),
        F.sum("wall_seconds").alias("wall_seconds"),
        *[F.sum(p).alias(p) for p in phases],
        F.sum("transitions").alias("transitions"),
        F.count("batch_fallback").alias("fallbacks"),
    )
    known = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in phases), F.lit(0.0))
    other = F.greatest(F.lit(0.0), F.col("wall_seconds") - known)
    return summed.withColumns({"other_seconds": other, "transitions_per_second": F.try_divide("transitions", F.nullif(F.col("wall_seconds"), F.lit(0.0)))})
