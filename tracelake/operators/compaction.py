"""Fewer, current files of a run in bucket layout."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EPISODE_SCHEMA, STEP_SCHEMA
from ..session import ship
from ..sources.files import delete, exists, list_files
from . import ledger
from .store import append_buckets, newest_complete, read_attempts

#: Tables of a run, in the order in which an attempt writes them.
TABLES = (("steps", STEP_SCHEMA), ("episodes", EPISODE_SCHEMA))


def bucket_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, bucket) of the files of both tables, by paths below the run."""
    both = None
    for name, _ in TABLES:
        found = list_files(spark, f"{root}/{name}", "*.parquet").where(F.col("path").rlike("^key_bucket=[^/]*/[^/]*$"))
        found = found.select(F.concat(F.lit(f"{name}/"), "path").alias("path"), F.regexp_extract("path", "^key_bucket=([^/]*)/", 1).alias("bucket"), F.lit(name).alias("name"))
        both = found if both is None else both.union(found)
    return both


def compact(spark: SparkSession, root: str, *, grace: float = 0.0, checkpoint: Callable[[str], None] | None = None) -> int:
    """Keep the newest complete attempt of each key, in one file a bucket, and delete the files that this supersedes; how many those were.

    The rows kept are appended as one more attempt, steps before episodes as always, so a reader finds them in the old files until the new ones are complete, and in
    the new ones from then on; old files go only then. So the tables are the same whenever a reader begins, also after a failure at any point, and another call
    comes to the end. A reader that began earlier keeps reading old files: ``grace`` seconds are left to it before they are deleted. Attempts that aren't complete go with their
    files. The steps are read as they are, bucket by bucket; nothing but names of files comes to the driver, a few for each bucket and attempt. Without a bucket of several files, nothing
    is written.
    """
    ship(spark)
    step = checkpoint or (lambda name: None)
    if not exists(spark, f"{root}/episodes/key_bucket=*"):
        return 0
    files = bucket_files(spark, root).checkpoint()
    if files.groupBy("name", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return 0
    step("listed")
    tables = {name: read_attempts(spark, f"{root}/{name}", schema) for name, schema in TABLES}
    attempts = tables["episodes"].agg(F.max("attempt")).first()[0]
    number = max(int(time.time() * 1000), (attempts or 0) + 1)  # newer than any, whatever the clock says
    kept = dict(zip(("episodes", "steps"), newest_complete(tables["episodes"], tables["steps"]), strict=True))
    for name, _ in TABLES:
        append_buckets(kept[name], f"{root}/{name}", number)
        step(f"{name} written")
    ledger.note(spark, root)
    step("noted")
    time.sleep(grace)
    gone = 0
    for row in files.orderBy(F.col("name").desc(), "path").toLocalIterator():
        delete(spark, f"{root}/{row['path']}")
        gone += 1
        step("deleted")
    return gone
