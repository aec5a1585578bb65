"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("long").cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, body, label) of about ``bound`` labelled documents at most, drawn by the hash of the id; rows held out are never drawn.

    Only labels 0 and 1 count; an id labelled more than once has its largest label.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("doc").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc"))).groupBy("doc").agg(F.max("label").alias("label"))
    total = known.count()
    share = min(1.0, bound / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    return texts.join(F.broadcast(drawn), "doc").select("doc", "body", "label")  # about ``bound`` pairs of numbers
