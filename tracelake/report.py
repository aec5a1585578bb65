"""A run's metrics by group: spark-submit report.py PATH --group-by task_id,perturbation"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

if not __package__:  # started as a script: the package's parent isn't on the path
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracelake.operators.metrics import metrics  # noqa: E402
from tracelake.operators.store import read_run  # noqa: E402


def grouped(spark: SparkSession, path: str, group_by: str = "") -> DataFrame:
    """Metrics of the run at ``path`` by the comma-separated episode columns; without any, over all episodes."""
    names = [name.strip() for name in group_by.split(",") if name.strip()]
    episodes = read_run(spark, path).episodes
    unknown = [name for name in names if name not in episodes.columns]
    if unknown:
        raise ValueError(f"episodes have no column {', '.join(unknown)}")
    found = metrics(episodes, *names)
    return found.orderBy(*names) if names else found


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("path", help="folder of a run")
    parser.add_argument("--group-by", default="", help="comma-separated episode columns")
    chosen = parser.parse_args(arguments)
    grouped(SparkSession.builder.appName("report").getOrCreate(), chosen.path, chosen.group_by).show(1000, truncate=False)


if __name__ == "__main__":
    main()
