"""Runs on any Hadoop file system: partitioned tables, readers that survive damage, and a write-once manifest.

In the key layout each episode has a directory of its own, so writing it again replaces it. In the bucket layout episodes share a fixed
number of directories and every attempt is appended; readers keep, for each key, the newest attempt whose steps are complete. It
is for plans whose episodes would be too many directories.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import EPISODE_SCHEMA, STEP_SCHEMA, TIMING_DDL
from ..sources.files import create_once, exists, read_text_file
from . import ledger
from .metrics import complete_keys, contiguous
from .traces import cast_to

BUCKETS = 64


def write_partitions(frame: DataFrame, root: str, by: str = "episode_key") -> None:
    """Overwrite the partitions that ``frame`` has rows of, and leave the others."""
    frame.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def append_buckets(frame: DataFrame, root: str, attempt: int | None = None, buckets: int = BUCKETS) -> None:
    """Append rows of one attempt to their buckets; without a number the frame's column ``attempt`` tells it."""
    added = {} if attempt is None else {"attempt": F.lit(attempt).cast("long")}
    bucket = F.pmod(F.xxhash64("episode_key"), F.lit(buckets)).cast("int")
    frame.withColumns({"key_bucket": bucket, **added}).repartition("key_bucket").write.partitionBy("key_bucket").mode("append").parquet(root)


def read_table(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The typed rows of a table in key layout; files that can't be read are skipped and stray directories ignored."""
    pattern = f"{root.rstrip('/')}/episode_key=*"
    if not exists(spark, pattern):
        return spark.createDataFrame([], schema)
    files = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("basePath", root).parquet(pattern)
    return cast_to(files, schema).where("episode_id is not null")


def read_sources(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """read_table() with the path of the file that each row comes from."""
    pattern = f"{root.rstrip('/')}/episode_key=*"
    if not exists(spark, pattern):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("source_path", StringType())]))
    files = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("basePath", root).parquet(pattern)
    return files.select("*", F.col("_metadata.file_path").alias("source_path")).where("episode_id is not null")


def read_attempts(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All attempts of a table in bucket layout."""
    full = StructType([*schema.fields, *StructType.fromDDL("attempt long").fields])
    pattern = f"{root.rstrip('/')}/key_bucket=*"
    if not exists(spark, pattern):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("ignoreCorruptFiles", "true").option("basePath", root).parquet(pattern).drop("key_bucket").where("episode_id is not null")


def newest_complete(episodes: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes and steps of each key's newest attempt whose steps are contiguous and as many as the episode says."""
    both = lambda frame: frame.withColumn("_try", F.concat_ws("/", "episode_key", "attempt"))
    good = contiguous(both(steps), key="_try")
    whole = both(episodes).join(good, "_try").where("length = n_rows")
    newest = whole.withColumn("_rank", F.row_number().over(Window.partitionBy("episode_key").orderBy(F.desc("attempt")))).where("_rank = 1")
    kept = newest.select("episode_key", "attempt")
    return newest.select([f"`{f.name}`" for f in EPISODE_SCHEMA]), steps.join(kept, ["episode_key", "attempt"]).select([f"`{f.name}`" for f in STEP_SCHEMA])


@dataclass(frozen=True)
class Run:
    """Lazy tables of a complete or partly complete run."""

    path: str
    run_id: str
    episodes: DataFrame
    steps: DataFrame

    def timings(self) -> DataFrame:
        spark, root = self.episodes.sparkSession, f"{self.path}/timings"
        return spark.read.schema(TIMING_DDL).json(root) if exists(spark, root) else spark.createDataFrame([], TIMING_DDL)


def read_run(spark: SparkSession, path: str) -> Run:
    """Open a run; one without a manifest is an error."""
    path = path.rstrip("/")
    text = read_text_file(spark, f"{path}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"run manifest not found: {path}/manifest.json")
    run_id = str(json.loads(text)["run_id"])
    if exists(spark, f"{path}/episodes/key_bucket=*"):
        episodes, steps = newest_complete(read_attempts(spark, f"{path}/episodes", EPISODE_SCHEMA), read_attempts(spark, f"{path}/steps", STEP_SCHEMA))
        return Run(path, run_id, episodes, steps)
    return Run(path, run_id, read_table(spark, f"{path}/episodes", EPISODE_SCHEMA), read_table(spark, f"{path}/steps", STEP_SCHEMA))


def completed(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(episode_key) of the episodes of a run that need no further attempt.

    By the run's ledger, so that only step files that it doesn't know are read; with ``whole``, by a scan of all steps.
    """
    if not whole:
        found = ledger.complete(spark, path, read_attempts if exists(spark, f"{path}/episodes/key_bucket=*") else read_table)
        if found is not None:
            return found
    run = read_run(spark, path)
    return complete_keys(run.episodes, run.steps)


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """The manifests of many runs as one table."""
    return spark.read.option("multiLine", "true").json(pattern)


def write_manifest(spark: SparkSession, root: str, run_id: str, config: Mapping[str, Any]) -> None:
    """Create a run's manifest; the same content again changes nothing, other content is an error. Of two writers at once one creates it."""
    payload = {"run_id": run_id, "config": dict(config)}
    path = f"{root.rstrip('/')}/manifest.json"
    text = json.dumps(payload, indent=2, sort_keys=True) + "\n"
    if create_once(spark, path, text.encode()):
        return
    for pause in (0.0, 0.1, 0.5, 2.0):  # the other writer may not have come to its end
        time.sleep(pause)
        try:
            found = json.loads(read_text_file(spark, path) or "")
        except ValueError:
            continue
        if found != json.loads(text):
            raise RuntimeError(f"{path} belongs to a run with another configuration (conflict); write to another folder")
        return
    raise RuntimeError(f"{path} was begun and never finished; delete it")


def append_timings(timings: DataFrame, root: str) -> None:
    """Append timing rows as JSON lines; NaN is an error, no rows write nothing."""
    found = timings.agg(F.count(F.lit(1)).alias("n"), *unusable(timings.columns)).first()
    no_nan(found.asDict())
    if found["n"]:
        timings.write.mode("append").json(root)


def unusable(columns: list[str], prefix: str = "") -> list[Column]:
    """How many rows have NaN for the seconds of each kind."""
    return [F.count_if(F.isnan(f"{prefix}{c}")).alias(f"nan_{c}") for c in columns if c.endswith("_seconds") or c.endswith("_per_second")]


def no_nan(found: Mapping[str, int]) -> None:
    bad = [name.removeprefix("nan_") for name, n in found.items() if name.startswith("nan_") and n]
    if bad:
        raise ValueError(f"timings hold NaN in {bad}")
