"""Whether the files that episodes name are there, and which files of a table can't be read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import arrow_store, decoded, exists, list_files, qualified, relative


def missing_media(episodes: DataFrame, root: str, columns: tuple[str, ...] = ("primary_video_path", "wrist_video_path")) -> DataFrame:
    """(episode_key, path, problem) of paths that no file has ("missing") or an empty one ("empty")."""
    named = episodes.select("episode_key", F.explode(F.array(*columns)).alias("path")).where("path is not null")
    files = list_files(episodes.sparkSession, root).select(F.col("path").alias("found"), "length")
    joined = named.join(files, named["path"] == files["found"], "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("length") == 0, "empty")
    return joined.select("episode_key", "path", problem.alias("problem")).where("problem is not null")


def leftovers(episodes: DataFrame, root: str, suffix: str = ".tmp") -> DataFrame:
    """(path) of temporary files that were left below ``root``."""
    return list_files(episodes.sparkSession, root).where(F.col("path").endswith(suffix)).select("path")


def damage(spark: SparkSession, root: str, schema: StructType, store: Callable = arrow_store) -> DataFrame:
    """(path, length, n_footer, n_read, problem) of the files below a partitioned table's root that its readers skip, in whole or in part.

    The numbers of rows that Parquet footers promise, read by tasks, meet those that Spark reads with ``schema`` while it skips what it can't read. "stray": not in a
    folder of the table's layout, so no reader looks at it; "unreadable": it has no footer, as when it was cut short or isn't Parquet; "wrong types": it has
    one, but columns whose types don't fit; "rows lost": fewer rows come than its footer promises. Whole files aren't listed. Lists of files and footers are made where
    ``store`` has a file system.
    """
    base = qualified(spark, root)
    files = list_files(spark, root, "*", store=store)
    placed = F.col("path").rlike("^(episode_key|key_bucket)=[^/]*/[^/]*[.]parquet$")
    wanted = {f.name: f.dataType.simpleString() for f in schema}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = store(base)
        for batch in batches:
            rows, fits = [], []
            for path in batch["path"].to_pylist():
                n = fit = None
                try:
                    with system.open_input_file(f"{top.rstrip('/')}/{path}") as file:
                        footer = pq.ParquetFile(file)
                        n, fit = footer.metadata.num_rows, _fits(footer.schema_arrow, wanted)
                except (pa.ArrowException, OSError, ValueError):
                    pass
                rows.append(n)
                fits.append(fit)
            yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], batch["placed"], pa.array(rows, pa.int64()), pa.array(fits, pa.bool_())], names=["path", "length", "placed", "n_footer", "fits"])

    footers = files.select("path", "length", placed.alias("placed")).mapInArrow(look, "path string, length long, placed boolean, n_footer long, fits boolean")
    read = spark.createDataFrame([], "path string, n_read long")
    pattern = next((p for p in ("episode_key=*", "key_bucket=*") if exists(spark, f"{root.rstrip('/')}/{p}")), None)
    if pattern is not None:
        scan = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("basePath", root).parquet(f"{root.rstrip('/')}/{pattern}")
        # all columns go into a result, so that none is left unread
        seen = scan.select(relative(base, decoded("_metadata.file_path")).alias("path"), F.hash(*[F.col(f"`{f.name}`") for f in schema]).alias("h"))
        read = seen.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h")).select("path", F.when(F.col("h").isNotNull(), F.col("n")).alias("n_read"))
    problem = (
        F.when(~F.col("placed"), "stray")
        .when(F.col("n_footer").isNull(), "unreadable")
        .when(~F.col("fits"), "wrong types")
        .when(F.col("n_read") < F.col("n_footer"), "rows lost")
    )
    found = footers.join(read, "path", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0).cast("long")))
    return found.select("path", "length", "n_footer", F.when(F.col("placed"), F.col("n_read")).alias("n_read"), problem.alias("problem")).where("problem is not null")


def _fits(held: pa.Schema, wanted: dict[str, str]) -> bool:
    """Whether the columns that a file has are of the types that are read."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "array<float>": pa.float32()}
    for name, kind in wanted.items():
        if name in held.names and kind in kinds:
            own = held.field(name).type
            if kind.startswith("array") != pa.types.is_list(own) or (own.value_type if pa.types.is_list(own) else own) != kinds[kind]:
                return False
    return True
