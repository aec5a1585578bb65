"""Connected components by contraction, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables


def connected_components(links: DataFrame) -> DataFrame:
    """(v, component) for every end of ``links`` (a, b); a component is named by its smallest vertex.

    Each round hooks every vertex to the first of its neighbours and itself, follows the pointers four steps and renames the ends of
    the links that are left. Which one is first is told by the ids in some rounds, which contract stars at once, and by a hash of them in the others, in which
    a path of any length falls into pieces of a few vertices; so rounds grow with the logarithm of the longest path. Labels are put together
    at the end from the pointers of all rounds. A null end or a loop links nothing.
    Each round writes tables of the links that are left; only whether there are any comes to the driver.
    """
    tables = Tables(links.sparkSession)
    every = tables.keep(links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, pointers = every.where("a <> b"), []
    while not left.isEmpty():
        up = tables.keep(_hooked(left, len(pointers)))
        up = tables.keep(_doubled(_doubled(up)))
        pointers.append(up)
        ends_a = up.select(F.col("x").alias("a"), F.col("to").alias("a2"))
        ends_b = up.select(F.col("x").alias("b"), F.col("to").alias("b2"))
        left = tables.keep(left.join(ends_a, "a").join(ends_b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    ends = every.select(F.col("a").alias("v")).union(every.select(F.col("b").alias("v"))).distinct()
    labels = ends.select("v", F.col("v").alias("component"))
    for up in pointers:
        labels = labels.join(up, F.col("component") == F.col("x"), "left").select("v", F.coalesce("to", "component").alias("component"))
    if len(pointers) > 1:  # after one round by ids the pointers lead to the smallest vertex
        labels = tables.keep(labels)
        names = labels.groupBy("component").agg(F.min("v").alias("name"))
        labels = labels.join(names, "component").select("v", F.col("name").alias("component"))
    labels = labels.checkpoint()
    tables.drop()
    return labels


def _hooked(links: DataFrame, turn: int) -> DataFrame:
    """Pointers (x, to) of the ends of links to the first of their neighbours and themselves: by id in turns 0, 2, 8, 16 and so on, else by hash."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if turn == 2 or turn % 8 == 0:
        return both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("x"), F.least("a", "to").alias("to"))
    rank = lambda c: F.xxhash64(c, F.lit(turn))
    first = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("to"))
    return first.select(F.col("a").alias("x"), F.when(rank("to") < rank("a"), F.col("to")).otherwise(F.col("a")).alias("to"))


def _doubled(up: DataFrame) -> DataFrame:
    """Pointers (x, to) followed once more."""
    again = up.select(F.col("x").alias("to"), F.col("to").alias("further"))
    return up.join(again, "to", "left").select("x", F.coalesce("further", "to").alias("to"))
