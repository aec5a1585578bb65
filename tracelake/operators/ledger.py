"""What is known of a run's step files, so that a resume reads only those it doesn't know.

The ledger is a table beside the steps: for each file, by its name and length, and each key and attempt in it, the number of rows and the checks of their frames. A file
of which nothing could be read has one row without a key. A file that goes, grows or shrinks no longer fits its rows, which then count for nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..schemas import EPISODE_SCHEMA, STEP_SCHEMA
from ..sources.files import decoded, exists, list_files
from .metrics import frame_checks, gapless

LEDGER = "path string, length long, episode_key string, attempt long, n_rows long, lo long, hi long, n_distinct long"
#: Unknown files that are read by their names; beyond, all steps are scanned.
FILES = 20_000
_STEPS = StructType([*STEP_SCHEMA.fields, StructField("attempt", LongType())])


def step_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files of a run's steps in either layout; files elsewhere aren't a run's."""
    return list_files(spark, f"{root}/steps", "*.parquet").where(F.col("path").rlike("^(episode_key|key_bucket)=[^/]*/[^/]*$"))


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("ignoreCorruptFiles", "true").parquet(f"{root}/ledger")


def steps_of(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, episode_key, attempt, frame_index) of the readable rows of some step files; the path is escaped, as scans have it."""
    base = f"{root}/steps"
    rows = spark.read.schema(_STEPS).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("basePath", base).parquet(*[f"{base}/{p}" for p in paths])
    path = F.substring_index("_metadata.file_path", "/", -2).alias("path")  # a folder and a name
    return rows.where("episode_id is not null").select(path, "episode_key", "attempt", "frame_index")


def note(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame | None:
    """Add the step files that the ledger doesn't know; the files (path, length) that there are now, or None if too many are unknown."""
    files = step_files(spark, root) if files is None else files
    known = read_ledger(spark, root).select("path", "length").distinct()
    unknown = files.join(known, ["path", "length"], "left_anti").limit(FILES + 1).collect()
    if len(unknown) > FILES:
        return None
    if unknown:
        new, names = F.broadcast(spark.createDataFrame(unknown, "path string, length long")), [c.split()[0] for c in LEDGER.split(", ")]
        found = frame_checks(steps_of(spark, root, [r["path"] for r in unknown]), "path", "episode_key", "attempt", deal=("episode_key",))
        # where they are: a file's keys don't meet in one task; paths are decoded once a key, not once a step
        found.withColumn("path", decoded("path")).join(new, "path").select(names).write.mode("append").parquet(f"{root}/ledger")
        kinds = StructType.fromDDL(LEDGER)
        empty = new.join(read_ledger(spark, root).select("path", "length").distinct(), ["path", "length"], "left_anti")
        empty.select([F.col(n) if n in ("path", "length") else F.lit(None).cast(kinds[n].dataType).alias(n) for n in names]).coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return files


def complete(spark: SparkSession, root: str, read: Callable[[SparkSession, str, StructType], DataFrame]) -> DataFrame | None:
    """(episode_key) of episodes with an attempt whose steps are all there; None if that takes a scan of all steps.

    ``read`` gives the episodes: read_table or read_attempts.
    """
    files = note(spark, root)
    if files is None:
        return None
    tried = F.coalesce("attempt", F.lit(-1).cast("long")).alias("attempt")
    few = files.limit(FILES + 1).count() <= FILES  # then each may have many keys, which would meet in one task
    known = (F.broadcast(files) if few else files).join(read_ledger(spark, root), ["path", "length"]).where("episode_key is not null").select("path", "episode_key", tried, "n_rows", "lo", "hi", "n_distinct").distinct()
    known = known.checkpoint()
    shared = known.groupBy("episode_key", "attempt").agg(F.count(F.lit(1)).alias("n_files")).where("n_files > 1").select("episode_key", "attempt")
    several = [r["path"] for r in known.join(shared, ["episode_key", "attempt"]).select("path").distinct().limit(FILES + 1).collect()]
    if len(several) > FILES:
        return None
    good = known.where(gapless())
    if several:  # a key's frames in several files are checked together
        rows = steps_of(spark, root, several).withColumn("attempt", tried).join(shared, ["episode_key", "attempt"], "left_semi")
        good = good.join(shared, ["episode_key", "attempt"], "left_anti").select("episode_key", "attempt", "n_rows").union(
            frame_checks(rows, "episode_key", "attempt").where(gapless()).select("episode_key", "attempt", "n_rows")
        )
    episodes = read(spark, f"{root}/episodes", EPISODE_SCHEMA)
    own = episodes.select("episode_key", "length", tried if "attempt" in episodes.columns else F.lit(-1).cast("long").alias("attempt"))
    return own.join(good.select("episode_key", "attempt", "n_rows"), ["episode_key", "attempt"]).where("length = n_rows").select("episode_key").distinct()
