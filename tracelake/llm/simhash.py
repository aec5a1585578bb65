"""Near copies by SimHash: 64-bit fingerprints of whole texts, compared exactly tile by tile with exclusive-or and bit counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import WORDS, word_parts
from .components import connected_components
from .near_dedup import with_class
from .tables import Tables

#: Different fingerprints in a tile, on average at most: half a megabyte.
TILE = 1 << 16
#: Fingerprint pairs that are compared in one numpy call.
CELLS = 1 << 18
_BYTES = 256 * np.arange(8)
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingle_hashes(text: bytes, k: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``k`` words, joined by a space; of all words, if they are fewer."""
    carried: list[bytes] = []
    done = False
    for part in word_parts(text, WORDS):
        words = carried + part
        if len(words) >= k:
            done = True
            yield _hashes(words, k, seed)
        carried = words[max(0, len(words) - k + 1) :]
    if carried and not done:
        yield _hashes(carried, len(carried), seed)


def _hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: bytes | None, k: int = 4, seed: int = 42) -> int:
    """Bit by bit, whether more than half of a text's shingle hashes have it; zero without words."""
    held, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text or b"", k, seed):
        n += len(hashes)
        for low in range(0, len(hashes), 1 << 16):  # how often each byte has each value, then the bits of the values
            places = hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8) + _BYTES
            held += (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * held > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int) -> DataFrame:
    """(doc, print): the fingerprint of each row that has an id, as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch["body"]
            found = np.array([fingerprint(body[i].as_buffer().to_pybytes() if body[i].is_valid else None, k, seed) for i in range(len(body))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(found.view(np.int64))], names=["doc", "print"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("body")).where("doc is not null")
    return texts.mapInArrow(sign, "doc long, print long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Documents whose SimHash fingerprints differ in at most ``radius`` bits are linked; the classes that links make.

    Words are runs of anything but ASCII space, A-Z lower-cased; a text's shingles are all runs of ``k`` words, repeats included, joined by a
    space (fewer words: the whole sequence; none: fingerprint zero, linked like any other). A bit of the fingerprint is one if more than half of the
    shingles' XXH64 have it. Copies have one fingerprint and are one class; different fingerprints are compared by tiles (see :func:`links`).

    One row per row of ``docs`` with an id: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id reachable). Null, empty and
    blank texts have fingerprint zero. Rows without an id are left out; rows that repeat an id are rows of their own. A text of any length is
    read in parts of some megabytes. An empty table gives no rows. Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    printed = tables.keep(fingerprints(docs, id_col, text_col, k, seed))
    classes = tables.keep(printed.groupBy("print").agg(F.min("doc").alias("v")))
    labels = connected_components(links(classes, radius)).select(F.col("v").alias("print"), F.col("component").alias("named"))
    linked = classes.join(labels, "print")
    names = linked.groupBy("named").agg(F.min("v").alias("component"))
    reps = classes.join(linked.join(names, "named").select("print", "component"), "print", "left").select("print", F.coalesce("component", "v").alias("component"))
    found = with_class(printed.withColumn("n", F.lit(1)), reps).checkpoint()
    tables.drop()
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def links(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect all fingerprints ``print`` (each given once) at up to ``radius`` differing bits as all such pairs would.

    Fingerprints with the same number of ones are cut by hash into tiles of about TILE. Two fingerprints differ in at least as many bits as their
    numbers of ones do, so a tile meets only tiles within ``radius`` of its own number; each such pair of tiles is one group, compared in full. A
    group returns a spanning forest of its links, so a family of near copies costs a link a member and not one a pair. As fingerprints are distinct
    and hashed, no tile is hot.
    """
    ones = F.bit_count("print")
    held = {row["ones"]: row["n"] for row in classes.groupBy(ones.alias("ones")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    slots = [math.ceil(held.get(p, 0) / TILE) for p in range(65)]
    starts = [sum(slots[:p]) for p in range(66)]
    lookup = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), ones + 1)
    first, count = lookup(starts[:65]), lookup([max(1, n) for n in slots])
    low, high = lookup([starts[max(0, p - radius)] for p in range(65)]), lookup([starts[min(65, p + radius + 1)] - 1 for p in range(65)])
    tile = (first + F.pmod(F.xxhash64("print"), count)).cast("int")
    tiles = classes.select(tile.alias("tile"), low.alias("low"), high.alias("high"), "print").groupBy("tile", "low", "high").agg(F.collect_list("print").alias("prints"))
    met = tiles.select("tile", "prints", F.explode(F.sequence("low", "high")).alias("other"))
    pairs = met.select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).alias("second"), "prints")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        sides = {s: p.values.to_numpy().view(np.uint64) for s, p in zip(group["second"].to_pylist(), group["prints"], strict=True)}
        if key[0] == key[1]:
            a, b = forest(sides[False], None, radius)
        elif len(sides) == 2:
            a, b = forest(sides[False], sides[True], radius)
        else:
            a = b = np.zeros(0, dtype=np.uint64)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return pairs.groupBy("i", "j").applyInArrow(compare, "a long, b long")


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of two tiles (or one), each of fingerprints with the same number of ones.

    Rows and columns are put in order of the ones in their upper halves. With x and y the differences of upper and lower halves, |x| + |y| <= radius
    leaves for each row's number one range of columns.
    """
    upper = lambda t: np.bitwise_count(t >> np.uint64(32)).astype(np.int64)
    left = left[np.argsort(upper(left), kind="stable")]
    right = left if right is None else right[np.argsort(upper(right), kind="stable")]
    if not len(left) or not len(right):
        return left[:0], left[:0]
    shift = 0 if right is left else len(left)
    every = left if right is left else np.concatenate([left, right])
    more = int(np.bitwise_count(right[0])) - int(np.bitwise_count(left[0]))
    fewest, most = -((radius - more) // 2), (radius + more) // 2
    rows, columns, parent = upper(left), upper(right), np.arange(len(every))
    for h in np.unique(rows).tolist():
        a, b = np.searchsorted(rows, [h, h + 1])
        c, d = np.searchsorted(columns, [h + (0 if right is left else fewest), h + most + 1])
        step = max(1, CELLS // max(1, d - c))
        for low in range(a, b if d > c else a, step):
            near = np.bitwise_count(left[low : min(low + step, b), None] ^ right[None, c:d]) <= radius
            at = np.flatnonzero(near)
            if len(at):
                parent = merged(parent, low + at // (d - c), shift + c + at % (d - c))
    own = np.flatnonzero(parent != np.arange(len(every)))
    return every[own], every[parent[own]]


def merged(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each vertex's component, after the links ``a`` to ``b``."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
