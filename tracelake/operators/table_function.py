"""Trials as a table function of SQL."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schemas import PLAN_SCHEMA, TRACE_SCHEMA
from ..session import ship
from .runner import BATCH, TrialSpec, made_by, traces_of

#: What a function may look at in a row, and a table must have.
NEEDED = tuple(f.name for f in PLAN_SCHEMA if f.name != "episode_index")


def register(spark: SparkSession, name: str, spec: TrialSpec, batch: int = BATCH) -> None:
    """Register ``name`` as a table function that runs a spec's trials: ``SELECT * FROM name(TABLE(plan) PARTITION BY seed)``.

    Its result has the table's columns and those of a trace. The function is made for each part at its first row, gets at most ``batch`` rows of the part at a time, and is closed at its
    end; so a part should be of one seed. Parts are groups of one task each: deal a seed with many rows further, as :func:`trials` does. A table
    without the columns of a plan is an error when the query is analysed.
    """
    ship(spark)
    arrow = to_arrow_schema(TRACE_SCHEMA)

    class Trials:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a table: {name}(TABLE(plan) PARTITION BY seed)")
            missing = sorted(set(NEEDED) - set(rows.dataType.names))
            if missing:
                raise ValueError(f"the table lacks columns of a plan: {missing}")
            return AnalyzeResult(StructType([*rows.dataType.fields, *TRACE_SCHEMA.fields]))

        def __init__(self):
            self.held: list[dict] = []
            self.made = None

        def eval(self, row: Row) -> Iterator[tuple]:
            self.held.append(row.asDict(recursive=True))
            if len(self.held) == batch:
                yield from self._run()

        def terminate(self) -> Iterator[tuple]:
            if self.held:
                yield from self._run()
            if self.made is not None and callable(getattr(self.made, "close", None)):
                self.made.close()

        def _run(self) -> Iterator[tuple]:
            self.made = made_by(spec) if self.made is None else self.made
            rows, self.held = self.held, []
            traces = pa.RecordBatch.from_pylist(traces_of(self.made, rows), schema=arrow).to_pylist()  # values of the types that traces have
            for row, trace in zip(rows, traces, strict=True):
                yield (*row.values(), *trace.values())

    spark.udtf.register(name, udtf(Trials))


def trials(plan: DataFrame, spec: TrialSpec, parts: int | None = None, batch: int = BATCH) -> DataFrame:
    """The rows of a plan with their traces, by a registered table function; the rows of a seed are dealt over ``parts`` parts by their keys.

    Traces are those of :func:`runner.execute`. By default there are as many parts as shuffle partitions.
    """
    spark = plan.sparkSession
    name = f"trials_{uuid.uuid4().hex}"
    register(spark, name, spec, batch)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan.createOrReplaceTempView(name)
    try:
        return spark.sql(f"SELECT * FROM {name}(TABLE({name}) PARTITION BY (seed, pmod(xxhash64(episode_key), {int(parts)})) ORDER BY (task_key, episode_id))")
    finally:
        with contextlib.suppress(Exception):
            spark.catalog.dropTempView(name)
