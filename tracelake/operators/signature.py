"""Content signatures and identities."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_json
from ..plans.validate import bucketed_hash, ordered_digests


def exact_signature(frame: DataFrame, sort_by: Sequence[str], columns: Sequence[str] | None = None) -> str:
    """SHA-256 of the sorted rows' compact JSON; for frames that fit the driver. NaN is an error."""
    names = list(columns or frame.columns)
    ordered = frame.select([f"`{c}`" for c in names]).orderBy([F.col(f"`{c}`") for c in sort_by])
    rows = [row.asDict(recursive=True) for row in ordered.collect()]
    text = json.dumps(rows, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False, default=lambda binary: binary.hex())
    return hashlib.sha256(text.encode()).hexdigest()


def signature(frame: DataFrame, key: str, bucket: Column | None = None, columns: Sequence[str] | None = None, rows_in_bucket: int = 1024) -> DataFrame:
    """(content_hash) of a frame of any size; equal however the frame is partitioned.

    Without ``bucket``, digests are hashed in a tree of two levels and a root, as wide as the rows need; a row's place is told by its key and digest, so that a hot key is dealt
    over many buckets. With it, rows meet in the caller's buckets, which are then put in one list. An empty frame has the hash of nothing.
    """
    digest = F.sha2(canonical_json(*(columns or frame.columns)), 256)
    if bucket is not None:
        return bucketed_hash(frame, digest, F.struct(F.col(f"`{key}`"), digest), bucket)
    level = frame.select(F.struct(F.col(f"`{key}`").cast("string").alias("key"), digest.alias("digest")).alias("o"), digest.alias("d"), F.lit(0).alias("twice"))
    width = max(1, math.ceil(frame.count() / rows_in_bucket))
    for buckets in (width, max(1, math.ceil(width / rows_in_bucket))):
        level = ordered_digests(level, F.pmod(F.xxhash64("o", F.lit(buckets)), F.lit(buckets)).cast("string"))
    return ordered_digests(level, F.lit("")).agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("content_hash"))


def group_signature(frame: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """(key, n_rows, content_hash) of each key's rows in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.sha2(canonical_json(*columns), 256).alias("d"))))
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.array_join(F.transform(rows, lambda x: x["d"]), "\n"), 256).alias("content_hash"))


def identity(config: Mapping[str, Any]) -> str:
    """The id of one configuration: the first 16 digits of SHA-256 of its compact, sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()[:16]


def identities(configs: DataFrame, *columns: str) -> Column:
    """The id of each row of a table of configurations."""
    return F.substr(F.sha2(canonical_json(*columns), 256), F.lit(1), F.lit(16))
