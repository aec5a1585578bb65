"""Resumable runs of a user's function over the pending rows of a plan."""

from __future__ import annotations

import contextlib
import math
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..plans.validate import cohorts, prepared
from ..schemas import ACTION_SIZE, PLAN_SCHEMA, TIMING_DDL, TRACE_SCHEMA
from ..session import ship
from ..sources.files import delete, exists
from . import ledger
from .metrics import pending as pending_rows
from .signature import identity
from .store import Run, append_buckets, completed, no_nan, read_run, unusable, write_manifest, write_partitions
from .traces import episode_table, step_table

#: Rows handed to a function at a time; version of the tables' schemas, a part of each run's identity.
BATCH, SCHEMA_VERSION = 8, 1
#: Cohorts of a large run, unless the caller gives their size.
COHORTS = 100


class TrialFunction(Protocol):
    """What a factory makes, once for each task. Traces are dictionaries of TRACE_SCHEMA.

    ``run_batch(rows)`` and ``close()`` are optional; without ``run_batch`` rows run one by one. So are ``action_dim`` and ``control_mode``; if a
    function declares them, they must be those of the tables and of its spec, which is checked when it is made. The rows of one call of
    ``run_batch`` have the same seed.
    """

    def run(self, row: Mapping[str, Any]) -> Mapping[str, Any]: ...


@dataclass(frozen=True)
class TrialSpec:
    """An identified factory of trial functions."""

    factory: Callable[[], TrialFunction]
    function_id: str
    revision: str
    control_mode: str = "relative"
    metadata: Mapping[str, Any] = field(default_factory=dict)
    #: What a task takes of an executor while the function runs; 0 leaves it to the session.
    task_cpus: int = 0
    task_gpus: float = 0.0

    def profile(self) -> ResourceProfile | None:
        """Resources of the stage that runs the function, and of no other stage; None for the session's own."""
        return task_profile(self.task_cpus, self.task_gpus)

    def __post_init__(self):
        if not self.function_id or not self.revision:
            raise ValueError("a trial function needs an id and a revision")
        if self.control_mode != "relative":
            raise ValueError("control mode must be 'relative'")


def task_profile(cpus: int = 0, gpus: float = 0.0) -> ResourceProfile | None:
    """A profile of tasks; executors stay as they are, so Spark only deals fewer tasks to each while it holds."""
    if cpus < 0 or gpus < 0:
        raise ValueError("resources can't be negative")
    if not cpus and not gpus:
        return None
    wanted = TaskResourceRequests().cpus(cpus or 1)
    return ResourceProfileBuilder().require(wanted.resource("gpu", gpus) if gpus else wanted).build


def made_by(spec: TrialSpec) -> TrialFunction:
    """A function whose declarations fit; one that doesn't runs nothing."""
    made = spec.factory()
    if not callable(getattr(made, "run", None)) and not callable(getattr(made, "run_batch", None)):
        raise TypeError(f"{spec.function_id} makes something without run() or run_batch()")
    width, mode = getattr(made, "action_dim", ACTION_SIZE), getattr(made, "control_mode", spec.control_mode)
    if int(width) != ACTION_SIZE:
        raise ValueError(f"{spec.function_id} declares actions of {width} values; tables hold {ACTION_SIZE}")
    if mode != spec.control_mode:
        raise ValueError(f"{spec.function_id} declares control mode {mode!r}, its spec {spec.control_mode!r}")
    return made


def same_seed(planned: list[dict], batch: int) -> Iterator[list[dict]]:
    """Runs of at most ``batch`` rows with the same seed, in order."""
    part: list[dict] = []
    for row in planned:
        if part and (len(part) == batch or row["seed"] != part[0]["seed"]):
            yield part
            part = []
        part.append(row)
    if part:
        yield part


def _check(trace: Mapping[str, Any], key: str) -> dict:
    """A trace as a plain dictionary; wrong action lengths are errors here, before anything is written."""
    steps = trace.get("steps") or []
    for step in steps:
        if step.get("action") is not None and len(step["action"]) != ACTION_SIZE:
            raise ValueError(f"trace {key}: action must have {ACTION_SIZE} values, got {len(step['action'])}")
    return {"num_steps": len(steps), **trace}


def traces_of(made: TrialFunction, rows: list[dict]) -> list[dict]:
    """The checked traces of rows of one seed, together if the function can."""
    together = getattr(made, "run_batch", None)
    traces = together(rows) if callable(together) else [made.run(r) for r in rows]
    return [_check(t, r["episode_key"]) for t, r in zip(traces, rows, strict=True)]


def _timing(rows: list[dict], traces: list[dict], started: float, fallback: str | None, more: Mapping[str, Any]) -> dict:
    wall, transitions = time.perf_counter() - started, sum(t["num_steps"] for t in traces)
    out = {"batch_size": len(rows), "episode_keys": [r["episode_key"] for r in rows], "wall_seconds": wall, "transitions": transitions, "transitions_per_second": transitions / wall if wall else None, "batch_fallback": fallback}
    if more:
        phases = {k: float(more.get(k, 0.0)) for k in ("reset_seconds", "settle_seconds", "policy_seconds", "environment_seconds")}
        out |= phases | {"other_seconds": max(0.0, wall - sum(phases.values())), "policy_calls": more.get("policy_calls")}
    return out


def execute(rows: DataFrame, spec: TrialSpec, batch: int = BATCH) -> DataFrame:
    """Plan rows with their traces. The function is made once for each task, at its first row, and closed at its end.

    The first trace of a batch carries the batch's timing. The stage runs with the spec's resources.
    """
    timing = StructType([StructField("timing", StructType.fromDDL(TIMING_DDL))])
    schema = StructType([*rows.schema.fields, *TRACE_SCHEMA.fields, *timing.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        try:
            for arrived in batches:
                planned = arrived.to_pylist()
                for part in same_seed(planned, batch):
                    made = made_by(spec) if made is None else made
                    together = getattr(made, "run_batch", None)
                    out: list[dict] = []
                    if callable(together):
                        started = time.perf_counter()
                        traces = traces_of(made, part)
                        profile = getattr(made, "batch_profile", None)
                        times = [_timing(part, traces, started, None, profile() if callable(profile) else {})] + [None] * (len(part) - 1)
                        out = [{**r, **t, "timing": x} for r, t, x in zip(part, traces, times, strict=True)]
                    else:
                        for r in part:
                            started = time.perf_counter()
                            (t,) = traces_of(made, [r])
                            out.append({**r, **t, "timing": _timing([r], [t], started, "no_batch_api", {})})
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
        finally:
            if made is not None and callable(getattr(made, "close", None)):
                made.close()

    return rows.mapInArrow(run, schema, profile=spec.profile())


def run_plan(
    plan: DataFrame, spec: TrialSpec, out: str, *, benchmark: str = "", revision: str = "", metadata: Mapping[str, Any] | None = None, write_video: bool = False,
    cohort_size: int | None = None, batch: int = BATCH, layout: str = "key", checkpoint: Callable[[], None] | None = None,
    implementation: str = "", environment: Mapping[str, str] | None = None,
) -> Run:
    """Run what is pending of a plan and return the run's tables.

    The run's id follows from the function, the benchmark, the plan's content, the schemas' version, and what the caller says of the code (``implementation``, such as a
    digest of it) and of the ``environment`` (such as versions of packages); a change of any of them is another run. Pending rows are the plan without the
    keys whose steps are complete, as the run's ledger of step files tells; they are written down before the first cohort, as the tables they come from are about to change. Of a new
    run all rows are pending and have their places already, so they are written by cohort at once. Each cohort's traces are staged, so the function runs once; then steps are
    written, then episodes: an episode row is the mark that its steps are there. A failure loses the cohort at most; by default there are up to COHORTS of them. Cohorts are
    chosen by a filter; no row passes through the driver. If nothing is pending, no function is made. What is
    staged below ``out`` goes when the call ends, well or not.
    """
    spark = plan.sparkSession
    ship(spark)
    with staged_below(spark, out) as staging:
        whole = prepared(plan, f"{staging}/plan")
        config = {
            "schema_version": SCHEMA_VERSION,
            "implementation": implementation,
            "environment": dict(environment or {}),
            "function": {"id": spec.function_id, "revision": spec.revision, "control_mode": spec.control_mode, "metadata": dict(spec.metadata)},
            "benchmark": {"name": benchmark, "revision": revision, "metadata": dict(metadata or {}), "write_video": write_video, "plan_sha256": whole.content_hash},
        }
        run_id = identity(config)
        root = f"{out.rstrip('/')}/{run_id}"
        write_manifest(spark, root, run_id, config)
        rows, n_left, names, begun = whole.rows, whole.n_rows, [f.name for f in PLAN_SCHEMA], exists(spark, f"{root}/episodes")
        if begun:
            left, seen = pending_rows(rows, completed(spark, root)), Observation()
            left.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{staging}/pending")
            rows, n_left = spark.read.schema(left.schema).parquet(f"{staging}/pending"), seen.get["n"]
        if not n_left:
            return read_run(spark, root)
        parallel = spark.sparkContext.defaultParallelism
        size = cohort_size or max(4 * parallel, 1000, math.ceil(n_left / COHORTS))
        count = math.ceil(n_left / size)
        if count > 1:  # a cohort reads its own folder only
            split = cohorts(rows, size, "episode_index", n_rows=n_left).repartition("cohort") if begun else rows.withColumn("cohort", F.floor(F.col("episode_index") / size).cast("long"))
            split.write.partitionBy("cohort").parquet(f"{staging}/cohorts")
            rows = spark.read.schema(split.schema).parquet(f"{staging}/cohorts")
        elif not begun:
            rows.write.parquet(f"{staging}/pending")
            rows = spark.read.schema(rows.schema).parquet(f"{staging}/pending")
        kinds = StructType([*PLAN_SCHEMA.fields, *TRACE_SCHEMA.fields, *StructType.fromDDL(f"timing struct<{_fields(TIMING_DDL)}>, attempt long").fields])
        attempt, order = int(time.time() * 1000), ("task_key", "seed", "episode_index")
        for number in range(count):
            part = (rows.where(F.col("cohort") == number) if count > 1 else rows).select(names)
            dealt = part.repartitionByRange(max(1, min(parallel, size)), *order).sortWithinPartitions(*order)
            # the attempt is a column by its folder: as a literal it would be a part of generated code, which each cohort would compile and run cold
            staged, timed = f"{staging}/traces/attempt={attempt + number}", Observation()
            done = execute(dealt, spec, batch)
            done.observe(timed, F.count("timing").alias("n"), *unusable(kinds["timing"].dataType.names, "timing.")).write.parquet(staged)
            traces, found = spark.read.schema(kinds).option("basePath", f"{staging}/traces").parquet(staged), timed.get
            no_nan(found)
            if layout == "key":
                write_partitions(step_table(traces), f"{root}/steps")
                write_partitions(episode_table(traces), f"{root}/episodes")
            else:
                append_buckets(step_table(traces, "attempt"), f"{root}/steps")
                append_buckets(episode_table(traces, "attempt"), f"{root}/episodes")
            if found["n"]:
                traces.where("timing is not null").select("timing.*").write.mode("append").json(f"{root}/timings")
            delete(spark, staged)
            if checkpoint is not None:
                checkpoint()
        ledger.note(spark, root)  # after a failure, the next call does it
        return read_run(spark, root)


@contextlib.contextmanager
def staged_below(spark: SparkSession, out: str) -> Iterator[str]:
    """A folder for what one call stages, deleted at its end."""
    folder = f"{out.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        delete(spark, folder)


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ", 1) for part in ddl.split(", ")))


def score(observations: DataFrame, factory: Callable[[], Callable[[Any], Any]], schema: str, batch: int = 512, profile: ResourceProfile | None = None) -> DataFrame:
    """Rows scored by a user's model, made once for each task: it gets pandas frames and returns frames of ``schema``.

    ``profile`` (see :func:`task_profile`) holds for the scoring stage alone.
    """

    def run(frames):
        model = factory()
        for frame in frames:
            for at in range(0, len(frame), batch):
                yield model(frame.iloc[at : at + batch])

    return observations.mapInPandas(run, schema, profile=profile)
