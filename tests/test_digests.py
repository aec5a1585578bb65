"""Digest trees and their differences."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tracelake.operators import digests as D
from tracelake.operators.signature import signature


def rows(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 97).alias("v"), F.concat(F.lit("t"), "id").alias("t"))


def change(frame):
    moved = frame.where("k <> 77").withColumn("v", F.when(F.col("k").isin(5, 1234), F.col("v") + 1).otherwise(F.col("v")))
    return moved.union(frame.sparkSession.sql("SELECT -3L, 1L, 'new'"))


def found(difference):
    return {r["key"]: (r["n_removed"], r["n_added"]) for r in difference.keys.collect()}


@pytest.mark.parametrize("named", [1000, 0])
def test_changed_rows_are_found_by_few_digests(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(D, "NAMED", named)
    n, a, b = 100_000, str(tmp_path / "a"), str(tmp_path / "b")
    D.write_tree(rows(spark, n), "k", a, depth=2)
    D.write_tree(change(rows(spark, n)).repartition(7), "k", b, depth=2)
    assert D.root_digest(spark, a) != D.root_digest(spark, b)
    difference = D.differences(spark, a, b)
    assert found(difference) == {"5": (1, 1), "1234": (1, 1), "77": (1, 0), "-3": (0, 1)}
    assert difference.n_read < 2 + 2 * 256 + 6 * 2 * 256 + 6 * 2 * 20
    assert D.read_level(spark, a, 3).agg(F.sum("n")).first()[0] == n == D.read_level(spark, a, 0).first()["n"]


def test_signatures_need_no_buckets(spark):
    frame = rows(spark, 3000).withColumn("hot", F.lit(1))
    whole = signature(frame, "k", rows_in_bucket=100).first()[0]
    assert whole == signature(frame.repartition(7), "k", rows_in_bucket=100).first()[0] and len(whole) == 64
    hot = signature(frame, "hot", rows_in_bucket=100)
    assert hot.first()[0] == signature(frame.repartition(3), "hot", rows_in_bucket=100).first()[0] != whole
    assert whole != signature(change(rows(spark, 3000)).withColumn("hot", F.lit(1)), "k", rows_in_bucket=100).first()[0]
    assert signature(frame.where("false"), "k").first()[0] == hashlib.sha256(b"").hexdigest()
    assert signature(frame, "k", columns=["v"]).first()[0] != signature(frame, "k", columns=["t"]).first()[0]


def test_equal_tables_take_two_digests(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    D.write_tree(rows(spark, 500), "k", a)
    D.write_tree(rows(spark, 500).repartition(5), "k", b)
    difference = D.differences(spark, a, b)
    assert (found(difference), difference.n_read) == ({}, 2)


def test_trees_of_odd_tables(spark, tmp_path):
    schema, place = "k string, v int", (str(tmp_path / str(n)) for n in range(20))

    def tree(data, **how):
        path = next(place)
        D.write_tree(spark.createDataFrame(data, schema), "k", path, **how)
        return path

    empty, some = tree([], depth=1), tree([(None, 1), ("", 1), ("a", 1), ("a", 1), ("a", 2)], depth=1)
    assert D.root_digest(spark, empty) is None and found(D.differences(spark, empty, empty)) == {}
    assert found(D.differences(spark, empty, some)) == {None: (0, 1), "": (0, 1), "a": (0, 2)} == {k: (b, a) for k, (a, b) in found(D.differences(spark, some, empty)).items()}
    assert found(D.differences(spark, some, tree([("a", 2), (None, 1), ("a", 1), ("", 1)], depth=1))) == {"a": (1, 1)}  # a row less of two alike
    assert found(D.differences(spark, some, tree([(None, 2), ("", 1), ("a", 1), ("a", 1), ("a", 2)], depth=1, columns=["k"]))) != {}
    with pytest.raises(ValueError, match="same depth"):
        D.differences(spark, some, tree([("a", 1)], depth=2))
    assert (D.depth_for(0), D.depth_for(256), D.depth_for(257), D.depth_for(10**6), D.depth_for(10**9)) == (0, 0, 1, 2, 3)


def test_names_and_digests_are_sent_as_bytes(spark, tmp_path, monkeypatch):
    sent, packed = [], D._packed
    monkeypatch.setattr(D, "_packed", lambda name: (sent.append(name), packed(name))[1])
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for path, frame in ((a, rows(spark, 2000)), (b, change(rows(spark, 2000)))):
        D.write_tree(frame, "k", path, depth=1)
    assert found(D.differences(spark, a, b)) == {"5": (1, 1), "1234": (1, 1), "77": (1, 0), "-3": (0, 1)} and {"node", "digest"} <= set(sent)
    leaves, digest = D.read_level(spark, a, 2), D.read_level(spark, a, 0).first()["digest"]
    nodes = {}
    for r in sorted(leaves.collect(), key=lambda r: r["node"]):
        nodes.setdefault(r["parent"], []).append(r["digest"])
    assert all(len(d) == 64 and d == d.lower() for own in nodes.values() for d in own)
    own = [hashlib.sha256("\n".join(nodes[p]).encode()).hexdigest() for p in sorted(nodes)]
    assert hashlib.sha256("\n".join(own).encode()).hexdigest() == digest
