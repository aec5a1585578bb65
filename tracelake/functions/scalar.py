"""Text, keys and numbers of plans and steps, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Step caps by suite; any other suite has the default.
STEP_CAPS = {"libero_spatial": 250, "libero_object": 280, "libero_10": 520, "libero_90": 400}
DEFAULT_STEP_CAP = 300
FRAMES_PER_SECOND = 20


def template(text: str, *columns: Column) -> Column:
    """``text`` with each "{}" replaced by a column; null if one of them is null."""
    parts = text.split("{}")
    if len(parts) != len(columns) + 1:
        raise ValueError(f"{text!r} needs {len(parts) - 1} columns, got {len(columns)}")
    pieces: list[Column] = [F.lit(parts[0])]
    for column, after in zip(columns, parts[1:], strict=True):
        pieces += [column.cast("string"), F.lit(after)]
    return F.concat(*pieces)


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match of ``pattern``; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def key_of(identity: Column) -> Column:
    """The key of an id. The letter before the hash keeps a partition value from being read as a number."""
    return F.concat(F.lit("e"), F.sha1(identity))


def step_cap(suite: Column, override: int | None = None) -> Column:
    if override is not None:
        return F.lit(override).cast("long")
    cap = F.lit(None)
    for name, steps in STEP_CAPS.items():
        cap = F.when(suite == name, steps) if name == "libero_spatial" else cap.when(suite == name, steps)
    return cap.otherwise(DEFAULT_STEP_CAP).cast("long")


def timestamp_of(frame: Column, frames_per_second: float = FRAMES_PER_SECOND) -> Column:
    return (frame / F.lit(float(frames_per_second))).cast("float")


def resolved(found: Column, planned: Column) -> Column:
    """What was found at run time, unless it is null or empty; else what was planned."""
    return F.coalesce(F.nullif(found, F.lit("")), planned)


def csv_items(text: Column) -> Column:
    """The trimmed, non-empty parts of comma-separated text."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_ids(text: Column) -> Column:
    """The parts as numbers if all are made of digits, else null: then they are keys."""
    items = csv_items(text)
    return F.when(F.size(items) > 0, F.when(F.forall(items, lambda x: x.rlike("^[0-9]+$")), F.transform(items, lambda x: x.try_cast("long"))))


def selected(column: Column, values: Sequence | None) -> Column:
    """Membership, if values are given at all; an empty list selects nothing."""
    return F.lit(True) if values is None else column.isin(list(values)) if values else F.lit(False)


def canonical_json(*names: str) -> Column:
    """Compact JSON of the columns in order of their names, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"})
