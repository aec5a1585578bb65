"""Schemas of plans, traces, episodes and steps. Vectors are arrays of floats whose length is checked when written and read."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, FloatType, LongType, StringType, StructField, StructType

ACTION_SIZE, STATE_SIZE, POSITION_SIZE = 7, 8, 3


def _schema(**fields: str) -> StructType:
    kinds = {"long": LongType(), "string": StringType(), "boolean": BooleanType(), "float": FloatType(), "vector": ArrayType(FloatType())}
    return StructType([StructField(name.replace("__", "."), kinds[kind]) for name, kind in fields.items()])


PLAN_SCHEMA = _schema(
    episode_index="long", episode_key="string", episode_id="string", benchmark="string", benchmark_revision="string", suite="string",
    suite_variant="string", perturbation="string", task_id="long", task_key="string", task_name="string", instruction="string",
    bddl_path="string", init_path="string", init_state_id="long", seed="long", max_steps="long",
)

#: A plan as a planner makes it; the index is given once the whole plan is known.
PLANNED = [f.name for f in PLAN_SCHEMA if f.name != "episode_index"]
REQUIRED = ["episode_key", "episode_id", "suite", "task_key", "init_state_id", "seed"]

_STEP = dict(
    frame_index="long", timestamp="float", action="vector", reward="float", next__done="boolean",
    observation__state="vector", observation__eef_position="vector", observation__gripper="float",
)

TRACE_SCHEMA = StructType(
    [
        *_schema(
            resolved_task_name="string", resolved_instruction="string", success="boolean", num_steps="long", reward="float",
            terminal_failure="string", primary_video_path="string", wrist_video_path="string",
        ).fields,
        StructField("steps", ArrayType(_schema(**_STEP))),
    ]
)

EPISODE_SCHEMA = _schema(
    episode_index="long", episode_key="string", episode_id="string", suite="string", suite_variant="string", perturbation="string",
    task_id="long", task_key="string", task_name="string", instruction="string", bddl_path="string", init_path="string",
    init_state_id="long", seed="long", success="boolean", length="long", reward="float", terminal_failure="string",
    primary_video_path="string", wrist_video_path="string",
)

STEP_SCHEMA = _schema(episode_index="long", episode_key="string", episode_id="string", task_key="string", **_STEP)

TIMING_DDL = (
    "batch_size long, episode_keys array<string>, wall_seconds double, reset_seconds double, settle_seconds double, policy_seconds double, "
    "environment_seconds double, other_seconds double, policy_calls long, transitions long, transitions_per_second double, batch_fallback string"
)
