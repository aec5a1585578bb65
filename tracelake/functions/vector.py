"""Actions, poses and images as array expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ACTION_SIZE, POSITION_SIZE, STATE_SIZE

ACTION_HORIZON = 7


def sized(vector: Column, size: int, what: str) -> Column:
    """The vector; another length is an error, null stays null."""
    bad = F.concat(F.lit(f"{what} must have {size} values, got "), F.size(vector).cast("string"))
    return F.when(vector.isNull() | (F.size(vector) == size), vector).otherwise(F.raise_error(bad).cast("array<float>"))


def clip(vector: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Each value kept within bounds; null and NaN stay as they are."""
    return F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x), x).when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x).cast("float"))


def clip_action(action: Column) -> Column:
    return clip(sized(action, ACTION_SIZE, "action"))


def gripper_width(joints: Column) -> Column:
    """The difference of the two joints in single precision; of one joint its value."""
    at = lambda k: F.get(joints, F.lit(k)).cast("float")
    return F.when(F.size(joints) >= 2, (at(0) - at(1)).cast("float")).otherwise(at(0))


def eef_position(position: Column) -> Column:
    return F.slice(position, 1, POSITION_SIZE).cast("array<float>")


def axis_angle(quaternion: Column) -> Column:
    """The rotation vector of an (x, y, z, w) quaternion: normalized, w kept within [-1, 1], zero where the axis is undefined."""
    q = quaternion.cast("array<double>")
    length = F.greatest(F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-8))
    part = lambda k: F.get(q, F.lit(k)) / length
    w = F.least(F.greatest(part(3), F.lit(-1.0)), F.lit(1.0))
    scale = F.sqrt(F.greatest(1 - w * w, F.lit(0.0)))
    turned = F.array(*[F.when(scale < 1e-6, F.lit(0.0)).otherwise(part(k) / scale * (2 * F.acos(w))).cast("float") for k in range(3)])
    return F.when(q.isNotNull(), turned)


def proprioception(position: Column, quaternion: Column, joints: Column) -> Column:
    """Position, rotation vector and two joints: 8 values; null if an input is missing."""
    parts = F.concat(eef_position(position), axis_angle(quaternion), F.slice(joints, 1, 2).cast("array<float>"))
    return sized(parts, STATE_SIZE, "proprioception")


def derotate(image: Column) -> Column:
    """An image (rows of pixels) turned by 180 degrees."""
    return F.transform(F.reverse(image), lambda row: F.reverse(row))


def binarize_gripper(action: Column) -> Column:
    """The action with its last value, in [0, 1], made -1 (over a half) or 1."""
    last = F.when(F.get(action, F.lit(ACTION_SIZE - 1)) > 0.5, F.lit(-1.0)).otherwise(F.lit(1.0)).cast("float")
    return F.concat(F.slice(action, 1, ACTION_SIZE - 1).cast("array<float>"), F.array(last))


def noise_digest(namespace: str, key: Column, seed: Column, chunk: Column) -> Column:
    """What a chunk's noise is seeded from: SHA-256 of namespace, key, seed and chunk, with zero bytes between, in hex."""
    return F.sha2(F.concat_ws("\0", F.lit(namespace), key, seed.cast("string"), chunk.cast("string")), 256)


def keyed_noise(namespace: str, key: Column, seed: Column, chunk: Column, horizon: int = ACTION_HORIZON, size: int = ACTION_SIZE) -> Column:
    """Standard normal values that depend on the key alone, not on the order of rows or partitions."""

    @F.pandas_udf("array<float>")
    def draw(digests: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in digests:
            yield batch.map(lambda d: None if d is None else _normal(bytes.fromhex(d), horizon * size))

    return draw(noise_digest(namespace, key, seed, chunk))


def _normal(digest: bytes, count: int) -> np.ndarray:
    return np.random.default_rng(int.from_bytes(digest[:16], "little")).standard_normal(count, dtype=np.float32)


def noise(namespace: str, key: str, seed: int, chunk: int, count: int = ACTION_HORIZON * ACTION_SIZE) -> np.ndarray:
    """The same values for one key, on the driver."""
    return _normal(hashlib.sha256(f"{namespace}\0{key}\0{seed}\0{chunk}".encode()).digest(), count)
