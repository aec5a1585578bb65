"""Actions, poses, images and noise, over the vectors of the embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.batches import with_structs
from ..operators import traces as T
from ..operators.runner import score
from .registry import Register, table

register = Register()


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _joined(array):
    """An array of floats as text, each value rounded to 5 decimals, so that both engines print the same."""
    return F.array_join(F.transform(array, lambda x: F.format_number(F.round(x.cast("double"), 5) + 0.0, 5)), " ")


def _sql(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: printf('%.5f', round(CAST(x AS DOUBLE), 5) + 0.0)), ' ')"


@register(f"""
SELECT vec_id, {_sql("list_transform(embedding[1:7], lambda x: CASE WHEN x > 0.1 THEN CAST(0.1 AS FLOAT) WHEN x < -0.1 THEN CAST(-0.1 AS FLOAT) ELSE x END)")} AS action FROM embeddings""")
def q_clip(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", _joined(V.clip(F.slice("embedding", 1, 7), -0.1, 0.1)).alias("action"))


_AXIS = """
SELECT vec_id, embedding, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS w,
       greatest(sqrt(x * x + y * y + z * z + w * w), 1e-8) AS n, least(greatest(w / n, -1.0), 1.0) AS c, sqrt(greatest(1 - c * c, 0.0)) AS s FROM embeddings"""
_TURN = "list_transform([x, y, z], lambda v: CAST(CASE WHEN s < 1e-6 THEN 0.0 ELSE v / n / s * (2 * acos(c)) END AS FLOAT))"


@register(f"WITH q AS ({_AXIS}) SELECT vec_id, " + ", ".join(f"round(CAST({_TURN}[{k}] AS DOUBLE), 4) AS r{k}" for k in (1, 2, 3)) + " FROM q")
def q_axis_angle(spark, sf_dir):
    turned = _vectors(spark, sf_dir).select("vec_id", V.axis_angle(F.slice("embedding", 1, 4)).alias("r"))
    return turned.select("vec_id", *[F.round(F.col("r")[k].cast("double"), 4).alias(f"r{k + 1}") for k in range(3)])


@register(f"WITH q AS ({_AXIS}) SELECT vec_id, " + ", ".join(f"round(CAST(p[{k}] AS DOUBLE), 4) AS p{k}" for k in range(1, 9)) + f" FROM (SELECT vec_id, list_concat(list_concat(embedding[5:7], {_TURN}), embedding[8:9]) AS p FROM q)")
def q_proprio(spark, sf_dir):
    v = F.col("embedding")
    state = V.proprioception(F.slice(v, 5, 3), F.slice(v, 1, 4), F.slice(v, 8, 2))
    made = _vectors(spark, sf_dir).select("vec_id", state.alias("p"))
    return made.select("vec_id", *[F.round(F.col("p")[k].cast("double"), 4).alias(f"p{k + 1}") for k in range(8)])


@register("""
SELECT vec_id, round(CAST(CAST(embedding[1] - embedding[2] AS FLOAT) AS DOUBLE), 6) AS two, round(CAST(embedding[3] AS DOUBLE), 6) AS one FROM embeddings""")
def q_gripper(spark, sf_dir):
    v = F.col("embedding")
    width = lambda *slice_: F.round(V.gripper_width(F.slice(v, *slice_)).cast("double"), 6)
    return _vectors(spark, sf_dir).select("vec_id", width(1, 2).alias("two"), width(3, 1).alias("one"))


@register(f"SELECT vec_id, {_sql('list_concat(embedding[1:6], [CAST(CASE WHEN embedding[7] + 0.5 > 0.5 THEN -1 ELSE 1 END AS FLOAT)])')} AS action FROM embeddings")
def q_binarize(spark, sf_dir):
    """Values are moved up by a half, as gripper values lie between 0 and 1."""
    v = F.col("embedding")
    action = F.concat(F.slice(v, 1, 6), F.array((v[6].cast("double") + 0.5).cast("double")))
    return _vectors(spark, sf_dir).select("vec_id", _joined(V.binarize_gripper(action.cast("array<double>"))).alias("action"))


@register("SELECT vec_id, CAST(i AS BIGINT) AS frame_index, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS action FROM embeddings, range(64) r(i)")
def q_chunk_expand(spark, sf_dir):
    """64 values as chunks of seven, the last of which is shorter."""
    chunks = _vectors(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("chunk"), "embedding")
    chunks = chunks.select("vec_id", "chunk", F.slice("embedding", F.col("chunk") * 7 + 1, F.lit(7)).alias("values"))
    frames = T.chunk_steps(chunks, "values", 7, "vec_id", chunk=F.col("chunk"))
    return frames.select("vec_id", "frame_index", F.round(F.col("action").cast("double"), 6).alias("action"))


@register(f"SELECT vec_id, {_sql('list_reverse(embedding)')} AS pixels FROM embeddings")
def q_derotate(spark, sf_dir):
    """64 values as an image of 8 rows, turned by 180 degrees."""
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    return _vectors(spark, sf_dir).select("vec_id", _joined(F.flatten(V.derotate(image))).alias("pixels"))


@register("""
SELECT vec_id, CAST(i AS BIGINT) AS index, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS a, round(CAST(embedding[i + 11] AS DOUBLE), 6) AS b, label
FROM embeddings, range(4) r(i)""")
def q_batched_rows(spark, sf_dir):
    """Two arrays of four values and one value for all, as four rows."""
    batches = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("a"), F.slice("embedding", 11, 4).alias("b"), "label")
    rows = T.batched_rows(batches, F.lit(4), ["vec_id"], ["a", "b", "label"])
    return rows.select("vec_id", "index", F.round(F.col("a").cast("double"), 6).alias("a"), F.round(F.col("b").cast("double"), 6).alias("b"), "label")


@register("SELECT doc_id, sha256('noise-v1' || chr(0) || doc_id || chr(0) || 7 || chr(0) || n_chars % 5) AS digest FROM documents")
def q_noise_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.select("doc_id", V.noise_digest("noise-v1", F.col("doc_id").cast("string"), F.lit(7), F.col("n_chars") % 5).alias("digest"))


@register()
def q_noise(spark, sf_dir):
    """Noise by key: the same whatever the order of rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    drawn = docs.select("doc_id", V.keyed_noise("noise-v1", F.col("doc_id").cast("string"), F.lit(7), F.lit(0)).alias("noise"))
    return drawn.select("doc_id", F.size("noise").alias("n_values"), F.sha2(F.array_join(F.transform("noise", lambda x: x.cast("string")), " "), 256).alias("noise_sha256"))


class _Linear:
    """A fixed linear model: value k weighs k / 100."""

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"vec_id": frame["vec_id"], "score": np.round(x @ (np.arange(1, x.shape[1] + 1) / 100), 6)})


@register("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (i / 100.0))), 6) AS score FROM embeddings")
def q_score_batch(spark, sf_dir):
    return score(_vectors(spark, sf_dir), _Linear, "vec_id long, score double")


def _summed(values: pd.Series, label: pd.Series) -> pd.DataFrame:
    x = np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.zeros((0, 1))
    return pd.DataFrame({"total": np.round(x.sum(axis=1), 6), "highest": x.argmax(axis=1).astype(np.int64), "twice": label.to_numpy().astype(np.int64) * 2})


@register("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS highest,
       CAST(label * 2 AS BIGINT) AS twice FROM embeddings""")
def q_score_struct(spark, sf_dir):
    """A function of two columns that gives three, made once a row in batches of 128."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return with_structs(rows, _summed, "total double, highest long, twice long", ["embedding", "label"]).select("vec_id", "total", "highest", "twice")
