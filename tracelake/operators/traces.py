"""Traces between their nested and their flat form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import resolved
from ..functions.vector import sized
from ..schemas import ACTION_SIZE, EPISODE_SCHEMA, POSITION_SIZE, STATE_SIZE, STEP_SCHEMA

_SIZES = {"action": ACTION_SIZE, "observation.state": STATE_SIZE, "observation.eef_position": POSITION_SIZE}


def cast_to(frame: DataFrame, schema: StructType, *more: str) -> DataFrame:
    """The schema's columns, each cast to its type, and ``more`` as they are."""
    return frame.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema], *more)


def checked(frame: DataFrame) -> DataFrame:
    """Vectors of a step table, with their lengths asserted."""
    return frame.withColumns({n: sized(F.col(f"`{n}`"), size, n) for n, size in _SIZES.items() if n in frame.columns})


def step_table(traces: DataFrame, *more: str) -> DataFrame:
    """One row per step of nested traces, with ``more`` columns of its trace; a trace without steps gives none."""
    own = ["episode_index", "episode_key", "episode_id", "task_key", *more]
    return checked(cast_to(traces.select(*own, F.explode("steps").alias("_step")).select(*own, "_step.*"), STEP_SCHEMA, *more))


def episode_table(traces: DataFrame, *more: str) -> DataFrame:
    """One row per trace, with ``more`` of its columns; what was resolved at run time stands for what was planned."""
    renamed = traces.withColumns(
        {
            "length": F.col("num_steps"),
            "task_name": resolved(F.col("resolved_task_name"), F.col("task_name")),
            "instruction": resolved(F.col("resolved_instruction"), F.col("instruction")),
        }
    )
    return cast_to(renamed, EPISODE_SCHEMA, *more)


def nest(steps: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], name: str = "steps") -> DataFrame:
    """One row per key, with its steps as an array of structs in order."""
    return steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))


def unnest(nested: DataFrame, name: str = "steps", outer: bool = False) -> DataFrame:
    """The inverse: one row per element, its fields as columns."""
    rest = [c for c in nested.columns if c != name]
    explode = F.explode_outer if outer else F.explode
    return nested.select(*rest, explode(name).alias("_step")).select(*rest, "_step.*")


def before_and_after(observations: DataFrame, key: str, order: str, before: Sequence[str], after: Sequence[str]) -> DataFrame:
    """Of an observation log, per action: the state it started from and the state it led to (the next observation's)."""
    by = Window.partitionBy(key).orderBy(order)
    return observations.withColumns({f"next_{c}": F.lead(c).over(by) for c in after}).select(key, order, *before, *[f"next_{c}" for c in after])


def chunk_steps(chunks: DataFrame, column: str, horizon: int, *keys: str, chunk: Column | None = None) -> DataFrame:
    """Frames of action chunks: frame t reads element t mod ``horizon`` of chunk t div ``horizon``."""
    number = chunk if chunk is not None else F.lit(0)
    rows = chunks.select(*keys, number.cast("long").alias("_chunk"), F.posexplode(column).alias("_pos", "action"))
    return rows.where(F.col("_pos") < horizon).select(*keys, (F.col("_chunk") * horizon + F.col("_pos")).alias("frame_index"), "action")


def batched_rows(batches: DataFrame, count: Column, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per index of dictionaries of batched arrays: element ``index`` of an array as long as ``count``, and any other value for all.

    A count of 0 gives no rows. An array of one element stands for all rows; one of yet another length can't be held by a
    column of elements and is an error. A null array gives nulls.
    """
    rows = batches.where(count > 0).select(*keys, *columns, F.explode(F.sequence(F.lit(0), count - 1)).alias("index"), count.alias("_n"))
    kinds = dict(batches.dtypes)

    def value(c: str) -> Column:
        if not kinds[c].startswith("array"):
            return F.col(c)
        bad = F.raise_error(F.concat(F.lit(f"{c} has "), F.size(c).cast("string"), F.lit(" values in a batch of "), F.col("_n").cast("string")))
        element = F.get(c, F.col("index"))
        return F.when(F.col(c).isNull(), F.lit(None)).when(F.size(c) == F.col("_n"), element).when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(bad.cast(kinds[c][6:-1]))

    return rows.select(*keys, F.col("index").cast("long").alias("index"), *[value(c).alias(c) for c in columns])
