"""Ranked lexical search: an exact sparse ball tree over the documents of each task, searched best first for every item."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import TERMS, word_parts
from .tables import Tables

#: Bytes of item texts in a block of items, on average; one pass over the documents answers a block.
ITEMS = 1 << 18
#: Entries (a term in a document) and documents in a tree, and documents in a leaf.
ENTRIES, DOCUMENTS, LEAF = 1 << 19, 8192, 8
#: Leaves that are scored in one go, those with the highest bounds first.
TOGETHER = 16
#: Far more than the rounding of a sum of as many products of doubles as a block has terms, relative to the sum of their sizes.
SLACK = 1e-9
#: Salts among which the findings of all tasks are merged before they meet by item.
SALTS = 64


def terms_of(text: bytes | None) -> Counter:
    """How often each term occurs in a text."""
    held: Counter = Counter()
    for part in word_parts(text or b"", TERMS):
        held.update(part)
    return held


class Sparse(NamedTuple):
    """Documents as sparse rows, none of them empty: entries of row k are those from at[k] to at[k + 1]."""

    at: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = (self.at[1:] - self.at[:-1])[rows]
        at = np.concatenate([[0], np.cumsum(sizes)])
        entries = np.repeat(self.at[rows] - at[:-1], sizes) + np.arange(at[-1])
        return Sparse(at, self.term[entries], self.value[entries])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """The inner product of each row with a dense vector."""
        return np.add.reduceat(self.value * dense[self.term], self.at[:-1])


class Tree(NamedTuple):
    """Balls around documents, the root first: ``radius`` of each; ``below``: the two smaller balls, or the range of documents of a leaf, as negatives.

    Centres are kept by term, sparse: entries ``starts[t]`` to ``starts[t + 1]`` are the balls with documents that have t, and their centres' coordinates.
    ``order`` are the documents in order of leaves.
    """

    order: np.ndarray
    radius: np.ndarray
    below: list[tuple[int, int]]
    starts: np.ndarray
    ball: np.ndarray
    centre: np.ndarray


def ball_tree(rows: Sparse, width: int, leaf: int = LEAF) -> Tree:
    """Documents are split by which of two documents far from each other is nearer; if that leaves one side small, at the median."""
    squares = np.add.reduceat(rows.value * rows.value, rows.at[:-1])
    order, radii, below, supports, centres = [], [], [], [], []

    def distances(part: Sparse, own: np.ndarray, point: np.ndarray) -> np.ndarray:
        return own - 2 * part.dot(point) + point @ point

    def dense(part: Sparse, k: int) -> np.ndarray:
        out = np.zeros(width)
        out[part.term[part.at[k] : part.at[k + 1]]] = part.value[part.at[k] : part.at[k + 1]]
        return out

    def grow(members: np.ndarray) -> int:
        part, own, number = rows.take(members), squares[members], len(radii)
        centre = np.bincount(part.term, weights=part.value, minlength=width) / len(members)
        apart = distances(part, own, centre)
        radii.append(math.sqrt(max(0.0, float((apart + SLACK * (own + centre @ centre)).max()))))
        supports.append(np.flatnonzero(centre))
        centres.append(centre[supports[-1]])
        below.append((-len(order), -len(order) - len(members)))
        if len(members) <= leaf:
            order.extend(members.tolist())
            return number
        first = dense(part, int(apart.argmax()))
        from_first = distances(part, own, first)
        lean = from_first - distances(part, own, dense(part, int(from_first.argmax())))
        near = lean < 0
        if not len(members) // 16 < near.sum() < len(members) - len(members) // 16:
            near = np.zeros(len(members), dtype=bool)
            near[np.argpartition(lean, len(members) // 2)[: len(members) // 2]] = True
        below[number] = grow(members[near]), grow(members[~near])
        return number

    grow(np.arange(len(rows.at) - 1))
    term = np.concatenate(supports)
    by_term = np.argsort(term, kind="stable")
    ball = np.repeat(np.arange(len(radii)), [len(x) for x in supports])[by_term]
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=width))])
    return Tree(np.array(order), np.array(radii), below, starts, ball, np.concatenate(centres)[by_term])


class Item(NamedTuple):
    """A query: its terms' numbers and weights."""

    term: np.ndarray
    weight: np.ndarray


class Best:
    """The highest-scoring documents met so far: scores descending, ids ascending."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def least(self) -> int:
        """The lowest score that may still come in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        fits = np.flatnonzero(scores >= self.least())
        if len(fits):
            scores, docs = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.docs, docs[fits]])
            order = np.lexsort((docs, -scores))[: self.k]
            self.scores, self.docs = scores[order], docs[order]


class Searcher:
    """Items whose best documents are kept while tree after tree is searched.

    Documents' coordinates are values times the roots of their terms' weights, items' are those roots, so that inner products are scores.
    """

    def __init__(self, items: list[Item], width: int, k: int):
        self.items, self.width, self.best = items, width, [Best(k) for _ in items]
        self.roots = np.zeros(width)
        for item in items:
            self.roots[item.term] = np.sqrt(item.weight)
        #: Pairs of an item and a document that were scored.
        self.scored = 0

    def bounds(self, tree: Tree, item: Item) -> np.ndarray:
        """No document of a ball scores more: the centre's product, and the radius times the length of the item in terms that the ball has at all."""
        starts, sizes = tree.starts[item.term], tree.starts[item.term + 1] - tree.starts[item.term]
        entries = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        query, ball = np.repeat(self.roots[item.term], sizes), tree.ball[entries]
        middle = np.bincount(ball, weights=query * tree.centre[entries], minlength=len(tree.radius))
        length = np.sqrt(np.bincount(ball, weights=query * query, minlength=len(tree.radius)))
        return (middle + length * tree.radius) * (1 + SLACK) + 1

    def search(self, docs: np.ndarray, rows: Sparse) -> None:
        tree = ball_tree(Sparse(rows.at, rows.term, rows.value * self.roots[rows.term]), self.width)
        docs, rows, below = docs[tree.order], rows.take(tree.order), tree.below
        weights = np.zeros(self.width, dtype=np.int64)
        for item, best in zip(self.items, self.best, strict=True):
            bounds = (-self.bounds(tree, item)).tolist()
            weights[item.term] = item.weight
            queue, least = [(bounds[0], 0)], -best.least()
            while queue:
                leaves = []
                while queue and len(leaves) < TOGETHER and queue[0][0] <= least:
                    a, b = below[heapq.heappop(queue)[1]]
                    if b > 0:
                        for ball in (a, b):
                            if bounds[ball] <= least:
                                heapq.heappush(queue, (bounds[ball], ball))
                    else:
                        leaves.append(np.arange(-a, -b))
                if not leaves:
                    break
                own = np.concatenate(leaves)
                best.add(rows.take(own).dot(weights), docs[own])
                least = -best.least()
                self.scored += len(own)
            weights[item.term] = 0


def counted(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, tfs): all terms of a document with repeats, and how often each term of the vocabulary occurs in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch["body"]:
                n, held = 0, Counter()
                if text.is_valid:
                    for part in word_parts(text.as_buffer().to_pybytes(), TERMS):
                        n += len(part)
                        held.update(map(number, part))
                held.pop(None, None)
                sizes.append(n)
                terms.append(np.fromiter(held.keys(), np.int32, len(held)))
                tfs.append(np.fromiter(held.values(), np.int64, len(held)))
                ends.append(ends[-1] + len(held))
            ends = pa.array(ends, pa.int32())
            flat = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(sizes, pa.int64()), *flat], names=["doc", "n", "terms", "tfs"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    return texts.mapInArrow(count, "doc long, n long, terms array<int>, tfs array<long>")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score; equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all that isn't ASCII, A-Z lower-cased. With N documents that have terms, L terms in all, n in a
    document, df documents with a term and tf occurrences in the document, a term's weight is floor(1000 ln((2N + 2) / (2df + 1))), m is
    50 + 50nN div L, and a score the sum over the item's distinct terms of weight * (10^9 tf div (1000 tf + 20m)).

    Documents are counted once for a block of items (the block's terms are a dictionary in each task, bounded by ITEMS bytes of text and one item) and
    written as sparse rows. Each task then builds ball trees over its rows, searches them best first for every item of the block and prunes balls
    that can't reach the item's ``k``-th score so far; bounds are in doubles and rounded up beyond what rounding may take, scores at leaves are whole
    numbers. The tasks' best are merged in two steps.

    Null, empty and term-free texts have no terms: they are found by nothing, and such items find nothing. Documents and items without an id are no results, but
    such documents count in N, L and df. Rows that repeat a document's id are documents of their own; rows that repeat an item's id are one item with the
    terms of all. Only scores above 0 are returned. A text of any length is read in parts of some megabytes. Empty tables give no rows. Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    texts = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").cast("binary").alias("body")).where("item is not null")
    blocks = max(1, math.ceil((texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0) / ITEMS))
    found = [_block(docs, id_col, text_col, texts.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, tables) for b in range(blocks)]
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = [F.desc("score"), F.col("doc")]
    best = best.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    best = best.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score").checkpoint()
    tables.drop()
    return best


def _block(docs: DataFrame, id_col: str, text_col: str, texts: DataFrame, k: int, tables: Tables) -> DataFrame:
    """(item, doc, score): the best of each task for a block of items."""
    terms: dict[int, set[bytes]] = {}
    for row in texts.toLocalIterator():
        terms.setdefault(row["item"], set()).update(terms_of(row["body"]))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*terms.values())))}
    rows = tables.keep(counted(docs, id_col, text_col, vocabulary))
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(vocabulary), dtype=np.int64)
    for row in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        weight[row["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    names = sorted(terms)
    queries = []
    for name in names:
        own = np.array(sorted(vocabulary[t] for t in terms[name]), dtype=np.int64)
        own = own[weight[own] > 0]  # other terms add nothing to a score
        queries.append(Item(own, weight[own]))
    width = len(vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(queries, width, k)
        for ids, sizes, part in _pieces(batches):
            m = 50 + (50 * sizes * n_docs) // n_terms
            tf = part.value
            value = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(part.at)))
            searcher.search(ids, Sparse(part.at, part.term, value))
        for name, best in zip(names, searcher.best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.docs), name)), pa.array(best.docs), pa.array(best.scores)], names=["item", "doc", "score"])

    return rows.where("doc is not null and size(terms) > 0").mapInArrow(search, "item long, doc long, score long")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Sparse]]:
    """Ids, numbers of terms and sparse rows of the documents of a task, as many at a time as a tree takes."""
    held: list[pa.RecordBatch] = []
    entries = documents = 0

    def joined() -> tuple[np.ndarray, np.ndarray, Sparse]:
        rows = pa.Table.from_batches(held).combine_chunks()
        at = np.concatenate([[0], np.cumsum(rows["terms"].combine_chunks().value_lengths().to_numpy())])
        term, tf = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
        return rows["doc"].to_numpy(), rows["n"].to_numpy(), Sparse(at, term, tf)

    for batch in batches:
        low = 0
        sizes = np.cumsum(batch["terms"].value_lengths().to_numpy()) if batch.num_rows else np.zeros(0, dtype=np.int64)
        while low < batch.num_rows:
            before = sizes[low - 1] if low else 0
            fits = int(np.searchsorted(sizes, before + ENTRIES - entries, side="right"))
            high = min(max(fits, low + (not held)), low + DOCUMENTS - documents, batch.num_rows)
            if high > low:
                held.append(batch.slice(low, high - low))
                entries, documents = entries + int(sizes[high - 1] - before), documents + high - low
            low = high
            if low < batch.num_rows:
                yield joined()
                held, entries, documents = [], 0, 0
    if held:
        yield joined()
