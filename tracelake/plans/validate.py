"""Checks, order and content hash of a plan."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical_json, key_of
from ..schemas import PLAN_SCHEMA, PLANNED, REQUIRED

#: Plans up to this many rows are indexed by one window; larger ones by ranges.
WINDOW_ROWS = 1_000_000
ORDER = ("suite", "task_key", "init_state_id", "seed", "episode_id")


def problems(plan: DataFrame) -> DataFrame:
    """One row: rows, nulls in each required column, distinct keys and ids. One job, whatever the plan's size."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED]
    return plan.agg(F.count(F.lit(1)).alias("n_rows"), *nulls, F.countDistinct("episode_key").alias("n_keys"), F.countDistinct("episode_id").alias("n_ids"))


def duplicates(plan: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def validate(plan: DataFrame) -> None:
    """Raise what is wrong with a plan, each case with its own message."""
    _has_columns(plan)
    found = problems(plan).first()
    _is_filled(found.asDict())
    if found["n_keys"] != found["n_rows"]:
        raise ValueError(DUPLICATE_KEYS)
    if found["n_ids"] != found["n_rows"]:
        raise ValueError(DUPLICATE_IDS)


DUPLICATE_KEYS, DUPLICATE_IDS = "plan contains duplicate episode keys", "plan contains duplicate episode ids"


def _has_columns(plan: DataFrame) -> None:
    missing = sorted(set(f.name for f in PLAN_SCHEMA) - set(plan.columns))
    if missing != ["episode_index"]:
        raise ValueError(f"plan is missing required columns: {missing!r}")


def _is_filled(found: dict) -> None:
    if found["n_rows"] == 0:
        raise ValueError("plan selection produced no episodes")
    for name in REQUIRED:
        if found[f"null_{name}"]:
            raise ValueError(f"plan contains null {name!r} values")


@dataclass(frozen=True)
class Prepared:
    """A valid plan with its dense index, how many rows it has, and its content hash."""

    rows: DataFrame
    n_rows: int
    content_hash: str


def prepared(plan: DataFrame, folder: str, rows_in_bucket: int = 1024) -> Prepared:
    """canonical() and plan_hash() of a plan that is evaluated once: it is written below ``folder``, and nulls and rows are counted as they are written.

    Equal keys fall into one bucket of the content hash, where they are found. If keys are those of the ids, as planners make them, ids are then
    known to differ as well; else they are compared in a job of their own.
    """
    _has_columns(plan)
    kinds = {f.name: f.dataType for f in PLAN_SCHEMA}
    seen = Observation()
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED]
    other = F.count_if(~F.col("episode_key").eqNullSafe(key_of(F.col("episode_id")))).alias("n_other_keys")
    typed = plan.select([F.col(c).cast(kinds[c]).alias(c) for c in PLANNED])
    typed.observe(seen, F.count(F.lit(1)).alias("n_rows"), *nulls, other).write.mode("overwrite").parquet(folder)
    found = seen.get
    _is_filled(found)
    written = plan.sparkSession.read.schema(typed.schema).parquet(folder)
    rows = dense_index(written, *ORDER, n_rows=found["n_rows"]).select([f.name for f in PLAN_SCHEMA])
    root = _hash_tree(rows, found["n_rows"], rows_in_bucket)
    if root["twice"]:
        raise ValueError(DUPLICATE_KEYS)
    if found["n_other_keys"] and not duplicates(written, "episode_id").isEmpty():
        raise ValueError(DUPLICATE_IDS)
    return Prepared(rows, found["n_rows"], root["d"])


def dense_index(rows: DataFrame, *order: str | Column, name: str = "episode_index", window_rows: int = WINDOW_ROWS, n_rows: int | None = None) -> DataFrame:
    """``rows`` numbered from 0 in order; they are counted unless ``n_rows`` tells how many there are.

    Up to ``window_rows`` rows one window does it; beyond, rows are dealt out by ranges of the order and sorted there, and each
    range starts where the ranges before it end, so no task sees all rows. The order must be total.
    """
    if (rows.count() if n_rows is None else n_rows) <= window_rows:
        return rows.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    ranged = ranged.checkpoint()
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_first"))  # one row a partition
    starts = sizes.withColumn("_start", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.join(F.broadcast(starts.drop("n")), "_part")
    return placed.withColumn(name, (F.col("_start") + F.col("_place") - F.col("_first")).cast("long")).drop("_part", "_place", "_first", "_start")


def canonical(plan: DataFrame) -> DataFrame:
    """A valid plan with its dense index, columns in their order."""
    validate(plan)
    return dense_index(plan.select(PLANNED), *ORDER).select([f.name for f in PLAN_SCHEMA])


def exact_hash(plan: DataFrame) -> str:
    """SHA-256 of the compact JSON of all rows in order of the index; for plans that fit the driver."""
    rows = [r.asDict() for r in plan.orderBy("episode_index").select([f.name for f in PLAN_SCHEMA]).toLocalIterator()]
    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def row_digest(*names: str) -> Column:
    return F.sha2(canonical_json(*names), 256)


def bucketed_hash(rows: DataFrame, digest: Column, order: Column, bucket: Column) -> DataFrame:
    """(content_hash) of any number of rows: digests in order within each of a fixed number of buckets, then over the buckets.

    It doesn't depend on how the rows are partitioned. A bucket's rows are put in order in one task, so the buckets should grow in number with the rows.
    """
    joined = lambda pairs: F.array_join(F.transform(F.array_sort(pairs), lambda x: x["d"]), "\n")
    parts = rows.select(bucket.alias("b"), F.struct(order.alias("o"), digest.alias("d")).alias("x")).groupBy("b").agg(F.sha2(joined(F.collect_list("x")), 256).alias("d"))
    return parts.agg(F.sha2(joined(F.collect_list(F.struct(F.col("b").alias("o"), "d"))), 256).alias("content_hash"))


def plan_hash(plan: DataFrame, rows_in_bucket: int = 1024) -> str:
    """The distributed content hash of a canonical plan: a tree of two levels, as wide as the plan needs.

    Buckets hold about ``rows_in_bucket`` digests, whatever the plan's size, and their own digests are hashed in the same way once more
    before the last step, so a billion rows meet in about a thousand digests.
    """
    return _hash_tree(plan, plan.count(), rows_in_bucket)["d"]


def _hash_tree(plan: DataFrame, n_rows: int, rows_in_bucket: int) -> Row:
    """The root's digest ``d``, and how many rows have the key of another (``twice``)."""
    digests = plan.select(F.col("episode_key").alias("o"), row_digest(*[f.name for f in PLAN_SCHEMA]).alias("d"), F.lit(0).alias("twice"))
    width = max(1, math.ceil(n_rows / rows_in_bucket))
    for level in (width, max(1, math.ceil(width / rows_in_bucket))):
        digests = ordered_digests(digests, F.pmod(F.xxhash64("o", F.lit(level)), F.lit(level)).cast("string"))
    return ordered_digests(digests, F.lit("")).first()


def ordered_digests(digests: DataFrame, group: Column) -> DataFrame:
    """(o, d, twice): for each group, the SHA-256 of its digests in order of ``o``, and how many repeat an ``o``."""
    held = digests.select(group.alias("g"), F.struct("o", "d").alias("x"), "twice").groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.sum("twice").alias("below"))
    repeated = F.size("xs") - F.size(F.array_distinct(F.transform("xs", lambda x: x["o"])))
    return held.select(F.col("g").alias("o"), F.sha2(F.array_join(F.transform("xs", lambda x: x["d"]), "\n"), 256).alias("d"), (F.col("below") + repeated).alias("twice"))


def cohorts(pending: DataFrame, size: int, *order: str, name: str = "cohort", n_rows: int | None = None) -> DataFrame:
    """Pending rows split in order into cohorts of ``size``."""
    if size < 1:
        raise ValueError("cohort size must be positive")
    return dense_index(pending, *order, name="_n", n_rows=n_rows).withColumn(name, F.floor(F.col("_n") / size).cast("long")).drop("_n")


def dry_run(plan: DataFrame, **settings: str) -> DataFrame:
    """summary() with the configuration that the run would have, one column a setting, as text; nothing is executed."""
    return summary(plan).withColumns({name: F.lit(None if value is None else str(value)).cast("string") for name, value in settings.items()})


def summary(plan: DataFrame) -> DataFrame:
    """What a run of the plan would do, by suite; the user's function isn't called."""
    return plan.groupBy("suite").agg(
        F.count(F.lit(1)).alias("episodes"), F.countDistinct("task_key").alias("tasks"), F.min("benchmark").alias("benchmark"), F.min("benchmark_revision").alias("benchmark_revision"), F.min("seed").alias("min_seed"), F.max("seed").alias("max_seed"), F.max("max_steps").alias("max_steps")
    )
