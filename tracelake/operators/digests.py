"""Digest trees of tables, kept by level, and the keys in which two tables differ."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical_json
from ..sources.files import exists

#: Hexadecimal digits that each level below the root adds to the names of nodes; leaves below a node of the last level of nodes, about.
DIGITS, LEAVES = 2, 256
#: Unequal nodes whose children are sought by name; beyond, a level is joined as a whole.
NAMED = 1000
_LEVEL = "parent string, node string, key string, digest string, n long"


def depth_for(rows: int) -> int:
    """Levels of nodes between the root and the leaves, so that the last ones have about LEAVES leaves."""
    levels = 0
    while rows > LEAVES * 16 ** (DIGITS * levels):
        levels += 1
    return levels


def _above(name: Column | str, levels: int) -> Column:
    return F.substr(name, F.lit(1), F.lit(DIGITS * levels))


def _packed(digits: str) -> Column:
    """Hexadecimal digits as bytes, half as many, in which names and digests are sent; their order is the same."""
    return F.unhex(digits).alias(digits)


def _digits(packed: Column | str) -> Column:
    return F.lower(F.hex(packed))


def write_tree(frame: DataFrame, key: str, path: str, columns: Sequence[str] | None = None, depth: int | None = None) -> None:
    """Write the digest tree of ``frame`` to ``path``: a folder for each level, with (parent, node, key, digest, n).

    A row's digest is the SHA-256 of the compact JSON of its columns. Leaves are the distinct pairs of key and digest, with how often they occur; a leaf's place is told by a
    hash of both, so that neither a hot key nor repeated rows make a large group. A node's digest is that of the digests of its children in order.
    It doesn't depend on how rows are partitioned. ``depth`` must be the same for trees that are compared; without it, rows are counted first. Levels are sorted by parent in their files, so children of
    few nodes are read from few row groups. A null key is a key of its own. An empty table has levels without rows.
    """
    depth = depth_for(frame.count()) if depth is None else depth
    row = F.unhex(F.sha2(canonical_json(*(columns or frame.columns)), 256))
    rows = frame.select(F.col(f"`{key}`").cast("string").alias("key"), row.alias("row")).groupBy("key", "row").agg(F.count(F.lit(1)).alias("n")).withColumn("row", _digits("row"))
    name = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), "key"), F.lit("")), F.lit("/"), "row"))
    level = rows.select(_above(name, depth).alias("parent"), name.alias("node"), "key", F.sha2(F.concat("row", F.lit("*"), F.col("n").cast("string")), 256).alias("digest"), "n")
    for k in range(depth, -1, -1):
        place = f"{path.rstrip('/')}/level={k + 1}"
        dealt = level.select("parent", _packed("node"), "key", _packed("digest"), "n").repartitionByRange("parent")
        written = dealt.select("parent", _digits("node").alias("node"), "key", _digits("digest").alias("digest"), "n")
        written.sortWithinPartitions("parent", "node").write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(place)
        children = F.array_sort(F.collect_list(F.struct(_packed("node"), _packed("digest"))))
        joined = F.array_join(F.transform(children, lambda x: _digits(x["digest"])), "\n")
        nodes = read_level(frame.sparkSession, path, k + 1).groupBy("parent").agg(F.sha2(joined, 256).alias("digest"), F.sum("n").alias("n"))
        level = nodes.select(_above("parent", max(0, k - 1)).alias("parent"), F.col("parent").alias("node"), F.lit(None).cast("string").alias("key"), "digest", "n")
    level.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/level=0")


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    """A level's nodes: 0 is the root, the last one the leaves."""
    return spark.read.schema(_LEVEL).parquet(f"{path.rstrip('/')}/level={level}")


def root_digest(spark: SparkSession, path: str) -> str | None:
    """The digest of a whole tree; None of an empty table."""
    found = read_level(spark, path, 0).first()
    return found["digest"] if found else None


@dataclass(frozen=True)
class Difference:
    """(key, n_removed, n_added) of the keys whose rows differ, and how many digests were read to find them."""

    keys: DataFrame
    n_read: int


def differences(spark: SparkSession, old: str, new: str) -> Difference:
    """The keys in which the table of tree ``new`` differs from that of ``old``, and how many distinct rows of each went and came; a changed row does both.

    Levels are read from the root down, and only children of unequal nodes, so equal trees take two digests and a changed row about two paths. Trees of different
    depths can't be compared, which is an error.
    """
    last = _last_level(spark, old)
    if last != _last_level(spark, new):
        raise ValueError(f"trees of {last} and {_last_level(spark, new)} levels; write both with the same depth")
    total, unequal, parents = 0, None, None
    for level in range(last + 1):
        sides, counts = [], [Observation(), Observation()]
        for tree, seen, side in ((old, counts[0], "a"), (new, counts[1], "b")):
            rows = read_level(spark, tree, level)
            if parents is not None:
                rows = rows.where(F.col("parent").isin(parents))
            elif unequal is not None:
                rows = rows.join(unequal.select(F.col("node").alias("parent")), "parent", "left_semi")
            sides.append(rows.observe(seen, F.count(F.lit(1)).alias("n")).select(_packed("node"), F.col("key").alias(f"key_{side}"), F.unhex("digest").alias(side)))
        unequal = sides[0].join(sides[1], "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).withColumn("node", _digits("node")).checkpoint()
        total += sum(map(_rows_seen, counts))
        names = [r["node"] for r in unequal.select("node").limit(NAMED + 1).collect()] if level < last else []
        if level < last and not names:
            break
        parents = names if len(names) <= NAMED else None
    one = lambda side: F.when(F.col(side).isNotNull(), 1).otherwise(0)
    leaves = unequal.select(F.coalesce("key_a", "key_b").alias("key"), one("a").alias("removed"), one("b").alias("added"))
    return Difference(leaves.groupBy("key").agg(F.sum("removed").alias("n_removed"), F.sum("added").alias("n_added")), total)


def _rows_seen(seen: Observation) -> int:
    """What was counted; Spark drops the count from a join that it finds to be empty."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0


def _last_level(spark: SparkSession, path: str) -> int:
    level = 0
    while exists(spark, f"{path.rstrip('/')}/level={level + 1}"):
        level += 1
    return level
