"""Nearest neighbours by inner product: cross-polytope hashing with multiprobe tables, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textarrays import mix

#: Queries whose exact answers set the layout and the number of probes; vectors or queries in a block; share of the answers that the probes must reach.
CALIBRATORS, BLOCK, TARGET = 200, 1024, 0.96
#: What a layout's cost is estimated from: vectors drawn by hash, calibrators; comparisons that take as long as sending a vector.
SAMPLE, ASKED, SEND = 4096, 40, 200
#: Cells with several blocks whose table is sent to all tasks at most.
BROADCAST = 100_000


@dataclass(frozen=True)
class Layout:
    """Tables, and how many axes, each of a rotation of its own, name a cell of a table."""

    axes: int
    tables: int

    def cells_in_table(self, size: int) -> int:
        return (2 * size) ** self.axes


LAYOUTS = tuple(Layout(axes, tables) for axes in (1, 2) for tables in (2, 4, 8))


def _signs(count: int, size: int) -> np.ndarray:
    bits = mix(np.arange(1, count * size + 1, dtype=np.uint64)) & np.uint64(1)
    return 1.0 - 2.0 * bits.reshape(count, size).astype(np.float64)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    rows, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(rows, size // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, size)
        step *= 2
    return x / math.sqrt(size)


def rotations(x: np.ndarray, size: int, count: int) -> Iterator[np.ndarray]:
    """The rows, padded to ``size``, by each of ``count`` pseudo-rotations: three times random signs and a Hadamard transform."""
    signs = _signs(3 * count, size)
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    for r in range(count):
        turned = padded
        for k in range(3):
            turned = hadamard(turned * signs[3 * r + k])
        yield turned


def signed(x: np.ndarray, size: int, layout: Layout) -> np.ndarray:
    """(tables, axes, rows, 2 * size): how near each row is to each signed axis of each rotation."""
    both = [np.stack([turned, -turned], axis=2).reshape(len(x), 2 * size) for turned in rotations(x, size, layout.tables * layout.axes)]
    return np.stack(both).reshape(layout.tables, layout.axes, len(x), 2 * size)


def cells(x: np.ndarray, size: int, layout: Layout) -> np.ndarray:
    """(rows, tables): the cell of the nearest signed axes in each table, numbered across tables."""
    near = signed(x, size, layout).argmax(axis=3)
    number = np.repeat(np.arange(layout.tables)[:, None], len(x), axis=1)
    for k in range(layout.axes):
        number = number * (2 * size) + near[:, k]
    return number.T


def probes(x: np.ndarray, size: int, layout: Layout, count: int) -> np.ndarray:
    """(rows, tables, count): the nearest cells of each table, nearest first, numbered like cells(): those with the largest sums over their axes."""
    most, total = min(count, 2 * size), layout.cells_in_table(size)
    near = signed(x, size, layout)
    number, value = np.zeros((layout.tables, len(x), 1), dtype=np.int64), np.zeros((layout.tables, len(x), 1))
    for k in range(layout.axes):  # the ``count`` best pairs are among the ``count`` best of either axis
        axis = np.argsort(-near[:, k], axis=2, kind="stable")[:, :, :most]
        number = (number[..., None] * (2 * size) + axis[:, :, None, :]).reshape(layout.tables, len(x), -1)
        value = (value[..., None] + np.take_along_axis(near[:, k], axis, axis=2)[:, :, None, :]).reshape(layout.tables, len(x), -1)
    best_ = np.argsort(-value, axis=2, kind="stable")[:, :, :count]
    out = np.take_along_axis(number, best_, axis=2) + (total * np.arange(layout.tables))[:, None, None]
    return out.transpose(1, 0, 2)


def probes_to(asked: np.ndarray, answers: np.ndarray, size: int, layout: Layout) -> np.ndarray:
    """For each pair of rows, after how many probes a table of the query's nearest cells the answer's cell is met."""
    near, home = signed(asked, size, layout), signed(answers, size, layout).argmax(axis=3)
    row = np.arange(len(asked))
    least = sum(near[:, k][np.arange(layout.tables)[:, None], row[None, :], home[:, k]] for k in range(layout.axes)) - 1e-9
    if layout.axes == 1:
        return (near[:, 0] >= least[:, :, None]).sum(axis=2).min(axis=0)
    second = np.sort(near[:, 1], axis=2)
    counts = [[2 * size * 2 * size - np.searchsorted(second[t, n], least[t, n] - near[t, 0, n]).sum() for n in row] for t in range(layout.tables)]
    return np.min(np.array(counts).reshape(layout.tables, len(row)), axis=0)


def _vectors(table: DataFrame, id_col: str, vector_col: str, dimension: int | None) -> tuple[DataFrame, int]:
    """(id, v) with usable vectors of one dimension, one for each id, and that dimension (unless given, the commonest; the larger of equals)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    short = "float" in table.select(F.col(f"`{vector_col}`")).dtypes[0][1]  # floats are sent as they are, and compared as doubles
    usable = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<float>" if short else "array<double>").alias("v"))
    usable = usable.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0.0))
    if dimension is None:
        most = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dimension = most["n"] if most else 1
    return usable.where(F.size("v") == dimension).groupBy("id").agg(F.max("v").alias("v")), dimension


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the ``k`` vectors nearest to each query, its own id left out.

    A matrix product picks who can be among them, with a margin for rounding; scores are then summed one pair at a
    time in the same way everywhere, so equal vectors have equal scores whatever block they are in.
    """
    rows, columns = [], []
    for low in range(0, len(queries), 256):
        product = queries[low : low + 256] @ vectors.T
        product[query_ids[low : low + 256, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            least = -np.partition(-product, k - 1, axis=1)[:, k - 1]
            margin = 1e-12 * (1 + np.abs(queries[low : low + 256]).sum(axis=1) * np.abs(vectors).max())
            row, column = np.nonzero((product >= (least - margin)[:, None]) & np.isfinite(product))
        else:
            row, column = np.nonzero(np.isfinite(product))
        rows.append(row + low)
        columns.append(column)
    row, column = np.concatenate(rows), np.concatenate(columns)
    score = (queries[row] * vectors[column]).sum(axis=1)
    order = np.lexsort((ids[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[column[place < k]], score[place < k]


FOUND = "query_id long, vec_id long, score double"


def _table(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.table({"query_id": query_ids.astype(np.int64), "vec_id": ids.astype(np.int64), "score": scores.astype(np.float64)})


def exact(queries: tuple[np.ndarray, np.ndarray], vectors: DataFrame, k: int, dimension: int) -> DataFrame:
    """The ``k`` nearest of a bounded number of queries, by comparing them with every vector."""
    ids, matrix = queries

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, found, score = best(matrix, ids, _matrix(batch["v"], dimension), batch["id"].to_numpy(), k)
                yield from _table(ids[row], found, score).to_batches()

    return ranked(vectors.mapInArrow(scan, FOUND), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, dimension: int | None = None) -> DataFrame:
    """The ``k`` nearest rows, by largest inner product, of each row for which ``is_query`` holds, among all rows but itself.

    Each table turns the vectors by pseudo-rotations of its own (three rounds of random signs and fast
    Hadamard transform), one or two, and puts each into the cell of its nearest signed axes. A query visits, in each table, the
    nearest cells; what it meets there is compared exactly. How many cells is set by measurement: for CALIBRATORS queries drawn
    by hash the exact answers are computed, and the fewest probes are taken that find TARGET of them. The layout is the one of LAYOUTS that then costs
    least: comparisons, counted with a sample of vectors, and vectors and queries sent. If vectors differ in length,
    they get one more coordinate that makes them equally long, which leaves inner products with queries in the same order.

    A query that meets fewer than ``k`` vectors then visits all of one table, that is, every vector once.

    Cells are cut into blocks of about BLOCK vectors and BLOCK queries, by the sizes of the cells, so a cell that holds a third of all rows is many tasks. Every row is indexed; only the best ``k`` of a query in
    a block leave it.

    Per query, nearest first: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (the inner product in double precision); ties go to the smaller id;
    fewer than ``k`` rows if there are fewer candidates. Vectors that are null, zero, of another dimension or that hold null or
    non-finite components take no part, nor do rows without an id. Rows that repeat an id are one vector, the
    greatest. An empty table gives no rows. Other columns are ignored.
    """
    spark = table.sparkSession
    all_, dimension = _vectors(table, id_col, vector_col, dimension)
    asked = table.where(is_query).select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct()
    vectors = all_.checkpoint()
    queries = vectors.join(asked, "id", "left_semi").checkpoint().select(F.col("id").alias("id"), F.col("v").alias("v"))
    square = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    low, high, count = vectors.agg(F.min(square), F.max(square), F.count("*")).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longer = low < 0.999 * high
    size = 1 << max(0, math.ceil(math.log2(dimension + longer)))

    def stored(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x / high, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True) / high**2))], axis=1) if longer else x

    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATORS).collect()
    sample = np.array([x["id"] for x in chosen]), np.array([x["v"] for x in chosen], dtype=np.float64).reshape(-1, dimension)
    n_queries = queries.count()
    layout, n_probes = _chosen(sample, vectors, k, dimension, size, stored, n_queries, count)

    def dealt(find):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    found = find(_matrix(part["v"], dimension)).reshape(len(part), -1)
                    row = np.repeat(np.arange(len(part)), found.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel().astype(np.int64)), part["id"].take(pa.array(row))], names=["cell", "id"])

        return run

    find_cells = lambda x: cells(stored(x), size, layout)
    find_probes = lambda x: probes(x, size, layout, n_probes)
    in_cell = vectors.mapInArrow(dealt(find_cells), "cell long, id long").checkpoint()
    in_probe = queries.mapInArrow(dealt(find_probes), "cell long, id long").checkpoint()
    found = _visited(in_cell, in_probe, vectors, queries, k, dimension).checkpoint()
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, count - 1)).select(F.col("query_id").alias("id"))
    short = queries.join(enough, "id", "left_anti").checkpoint()
    if short.isEmpty():
        return found
    first = layout.cells_in_table(size)
    by_axis = in_cell.where(F.col("cell") < first).withColumn("cell", F.expr(f"cell div {first // (2 * size)}"))  # the first table by its first axis alone
    all_cells = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * size - 1).cast("long"))).alias("cell"), "id")
    filled = _visited(by_axis, all_cells, vectors, short, k, dimension)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(found.columns).union(filled)


def _visited(in_cell: DataFrame, in_probe: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, dimension: int) -> DataFrame:
    """The ``k`` nearest of each query among the vectors that share a (cell, id) with it, compared block by block."""
    parts = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = parts(in_cell, "of_vectors").join(parts(in_probe, "of_queries"), "cell").checkpoint()
    beside = F.broadcast(blocks) if blocks.count() <= BROADCAST else blocks

    def spread(rows: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        """Each row to its own block among ``own``, and to all blocks of the other side."""
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(names[0])
        return rows.join(beside, "cell").select("cell", "id", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]))

    left = spread(in_cell, "of_vectors", "of_queries", ("vb", "qb")).join(vectors, "id").select("cell", "vb", "qb", "id", "v")
    right = spread(in_probe, "of_queries", "of_vectors", ("qb", "vb")).join(queries, "id").select("cell", "vb", "qb", F.col("id").alias("id"), F.col("v").alias("v"))

    def compare(own: pa.Table, asked_: pa.Table) -> pa.Table:
        if not own.num_rows or not asked_.num_rows:
            return _table(np.zeros(0), np.zeros(0), np.zeros(0))
        query_ids = asked_["id"].to_numpy()
        row, ids, score = best(_matrix(asked_["v"], dimension), query_ids, _matrix(own["v"], dimension), own["id"].to_numpy(), k)
        return _table(query_ids[row], ids, score)

    keys = ("cell", "vb", "qb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, FOUND)
    return ranked(found.distinct(), k)


def _chosen(sample: tuple[np.ndarray, np.ndarray], vectors: DataFrame, k: int, dimension: int, size: int, stored, n_queries: int, n_vectors: int) -> tuple[Layout, int]:
    """The layout that costs least, and the fewest probes a table with which it meets TARGET of the exact answers to the sample."""
    ids, matrix = sample
    if not len(ids):
        return LAYOUTS[0], 1
    answers = exact(sample, vectors, k, dimension).join(vectors.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("query_id", "v").collect()
    if not answers:
        return LAYOUTS[0], 1
    row_of = {q: n for n, q in enumerate(ids.tolist())}
    asked, found = matrix[[row_of[x["query_id"]] for x in answers]], stored(np.array([x["v"] for x in answers], dtype=np.float64))
    some = stored(np.array([x["v"] for x in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], dtype=np.float64))
    best_ = None
    for layout in LAYOUTS:
        needed = np.concatenate([probes_to(asked[at : at + 500], found[at : at + 500], size, layout) for at in range(0, len(asked), 500)])
        count = int(np.sort(needed)[max(0, math.ceil(TARGET * len(needed)) - 1)])
        if count > 2 * size:  # more cells than a table of one axis has
            continue
        home, visited = cells(some, size, layout), probes(matrix[:ASKED], size, layout, count)
        share = np.mean([sum(np.isin(home[:, t], v[t]).mean() for t in range(layout.tables)) for v in visited])
        cost = share * n_queries * n_vectors + SEND * layout.tables * (n_vectors + count * n_queries)
        if best_ is None or cost < best_[0]:
            best_ = cost, layout, count
    return best_[1:]
