"""Intermediate tables of iterative jobs, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Parquet tables below the checkpoint folder, deleted together or one by one.

    They cut lineage as checkpoint() does and survive the loss of executors. Unlike a checkpointed frame, a table that is read has the statistics of its
    files: those of a checkpointed frame are the estimates of its plan, and the estimated size of joins of joins grows
    from round to round until the planner multiplies numbers of millions of digits.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.sparkContext.getCheckpointDir()
        if base is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self.root, self.paths = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}", []

    def keep(self, frame: DataFrame) -> DataFrame:
        """Write ``frame`` and return the table."""
        path = f"{self.root}/{len(self.paths)}"
        self.paths.append(path)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self) -> None:
        """Delete all tables kept so far."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
