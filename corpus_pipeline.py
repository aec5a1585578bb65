"""A corpus made ready for training: toxic documents, near copies, repeated passages and benchmark leaks go; the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Rows without an id go through: they can't be named in a link or
a pair, so only the toxicity stage can reject them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, near_dedup, sentencepiece_codec, substring_dedup, toxicity
from tracelake.llm.queries import PIECES
from tracelake.session import ship

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the operator's threshold go."""
    ship(spark)
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    ship(spark)
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document without any keeps its text as it is."""
    ship(spark)
    found = substring_dedup.remove_repeats(docs, layout=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    pairs = decontaminate.tiled_pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it."""
    ship(spark)
    return sentencepiece_codec.round_trips(docs, PIECES, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the checkpoint folder before the next stage reads it."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        docs = docs.checkpoint() if n < len(STAGES) else docs
    return docs
