"""What a session needs before functions of this package run on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors through Spark, once an application, and see that checkpoints have a folder.

    The folder is the one that the session names in spark.checkpoint.dir. Only a session on one machine gets a temporary one if it names none;
    on a cluster that is an error, as executors can't see each other's folders.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="tracelake-"), "tracelake.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracelake-checkpoints-"))
    _shipped.add(context.applicationId)
