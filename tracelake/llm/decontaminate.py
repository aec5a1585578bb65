"""Benchmark passages in documents, found by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import LOWER, WHITE, inside, ngram_hashes, slices, text_bytes, word_hashes, word_spans

#: Size of the bit table that holds the seeds' leading bits: half a megabyte, however many seeds there are.
SEED_BITS = 22

#: Documents of a seed that meet its items in one task at least, and a bound on the number of seeds that are dealt over several tasks.
SALT_ROWS, MAX_HOT = 50_000, 1000

#: Letters, digits and everything outside ASCII make up tokens; the rest is a gap like a space.
_GAPS = WHITE.copy()
_GAPS[[b for b in range(128) if not chr(b).isalnum()]] = True
_FOLD = np.where(_GAPS, np.uint8(0x20), LOWER).astype(np.uint8)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased tokens of a column's texts, and for each text the number of tokens before it."""
    hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
    for low, high in slices(column):
        data, at = text_bytes(column.slice(low, high - low))
        data = _FOLD[data]
        starts, ends, first = word_spans(data, at)
        hashes.append(word_hashes(data, starts, ends))
        counts.append(np.diff(first))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (place in item, place in doc, length), no token used twice.

    Running Karp-Rabin: windows of one length are matched by hash and grown to the right; the longest matches are
    marked first; then the scan repeats with windows half as long, down to ``shortest``.
    """
    used_item, used_doc = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    found, length = [], len(item)
    while length >= shortest:
        queue = [(-size, i, j) for size, i, j in _matches(item, doc, used_item, used_doc, length)]
        heapq.heapify(queue)
        while queue:  # longest first, then by place; what a marked match has taken tokens from comes back as its free parts
            size, i, j = heapq.heappop(queue)
            taken = used_item[i : i - size] | used_doc[j : j - size]
            if not taken.any():
                used_item[i : i - size] = used_doc[j : j - size] = True
                found.append((i, j, -size))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for low, high in edges.reshape(-1, 2).tolist():
                if high - low >= length:
                    heapq.heappush(queue, (low - high, i + low, j + low))
        length = max(shortest, length // 2) if length > shortest else 0
    return sorted(found)


def _matches(item: np.ndarray, doc: np.ndarray, used_item: np.ndarray, used_doc: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Matches of unused tokens, ``length`` or longer, that can't be grown; longest first, then by place."""

    def free(used: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(used)])
        return np.flatnonzero(sums[length:] == sums[:-length]) if len(used) >= length else np.zeros(0, dtype=np.int64)

    at_item, at_doc = free(used_item), free(used_doc)
    hash_item, hash_doc = ngram_hashes(item, length)[at_item], ngram_hashes(doc, length)[at_doc]
    at_doc = at_doc[np.isin(hash_doc, hash_item)]
    places: dict[int, list[int]] = {}
    for i, h in zip(at_item.tolist(), hash_item.tolist(), strict=True):
        places.setdefault(h, []).append(i)
    all_doc = ngram_hashes(doc, length)
    out = []
    for j in at_doc.tolist():
        for i in places[int(all_doc[j])]:
            if i and j and not used_item[i - 1] and not used_doc[j - 1] and item[i - 1] == doc[j - 1]:
                continue  # part of a match that starts earlier
            most = min(len(item) - i, len(doc) - j)
            ends = np.flatnonzero((item[i : i + most] != doc[j : j + most]) | used_item[i : i + most] | used_doc[j : j + most])
            out.append((int(ends[0]) if len(ends) else most, i, j))
    return sorted(out, key=lambda m: (-m[0], m[1], m[2]))


def seeds_of(items: DataFrame, id_col: str, text_col: str, shortest: int) -> DataFrame:
    """(item, n, words, k, place, seed): the runs of ``shortest`` tokens of each item; a shorter item is one run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = tokens(batch["body"])
            for item, a, b in zip(batch["item"].to_pylist(), first[:-1], first[1:], strict=True):
                if b > a:
                    k = min(shortest, b - a)
                    seeds = ngram_hashes(hashes[a:b], k).view(np.int64)
                    n = len(seeds)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item": pa.array([item] * n, pa.int64()),
                            "n": pa.array([b - a] * n, pa.int64()),
                            "k": pa.array([k] * n, pa.int32()),
                            "place": pa.array(range(n), pa.int32()),
                            "seed": pa.array(seeds),
                        }
                    )

    texts = items.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").alias("body")).where("item is not null and body is not null")
    return texts.mapInArrow(cut, "item long, n long, k int, place int, seed long")


def _covered(present: np.ndarray, k: int) -> int:
    """How many tokens lie in the runs of ``k`` tokens that are present."""
    edges = np.zeros(len(present) + k, dtype=np.int64)
    edges[: len(present)] += present
    edges[k:] -= present
    return int((np.cumsum(edges) > 0).sum())


def telling_seeds(counted: DataFrame, percent: int) -> DataFrame:
    """(item, k, seed) of so many seeds of each item that a document without any of them can't have ``percent`` of the item's tokens in tiles.

    ``counted`` is what seeds_of() gives, with how many documents have each seed (``n_docs``, null for none). Tiles consist of seeds that both texts have. The seeds left out, commonest first, cover less
    than ``percent`` of the tokens together, so a document that has only those is no match. A phrase of many items and many documents is thus left out wherever
    an item has enough else to be told by. Only seeds that some document has are returned.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                (row,) = batch.slice(n, 1).to_pylist()
                places: dict[int, list[int]] = {}
                for held in row["held"]:  # commonest first
                    places.setdefault(held["seed"], []).append(held["place"])
                number, covered, n_covered, kept = {h["seed"]: -h["rarity"] for h in row["held"]}, bytearray(row["n"]), 0, []
                for seed, at in places.items():
                    new = {t for p in at for t in range(p, p + row["k"]) if not covered[t]}
                    if 100 * (n_covered + len(new)) >= percent * row["n"]:
                        kept.append(seed)
                        continue
                    n_covered += len(new)
                    for t in new:
                        covered[t] = 1
                kept = [seed for seed in kept if number[seed]]
                if kept:
                    yield pa.RecordBatch.from_pydict({"item": pa.array([row["item"]] * len(kept), pa.int64()), "k": pa.array([row["k"]] * len(kept), pa.int32()), "seed": pa.array(kept, pa.int64())})

    rarity = (-F.coalesce("n_docs", F.lit(0))).alias("rarity")
    items = counted.groupBy("item", "n", "k").agg(F.array_sort(F.collect_list(F.struct(rarity, "seed", "place"))).alias("held"))
    return items.mapInArrow(choose, "item long, k int, seed long").distinct()


def tiled_pairs(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shortest: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Pairs of a document and a benchmark item of whose tokens ``percent`` or more lie in common tiles of ``shortest`` tokens or more.

    Tokens are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Documents without any seed
    (run of ``shortest`` tokens) of the benchmark are passed over in the scan, by a bit table of fixed size; the seeds of the rest
    join the rarer seeds of the items (see :func:`telling_seeds`), hot ones dealt over several tasks, and pairs whose seeds could cover enough of the item are tiled: matches are taken longest first and
    never overlap, so a passage whose parts were put in another order still counts in full.

    One row per pair: ``doc_id``, ``item_id``, ``n_item`` (its tokens), ``n_covered``, ``n_tiles``, ``tiles`` (place in item, place
    in document, length). An item shorter than ``shortest`` counts if it occurs whole. Null ids, null texts and
    texts without tokens are in no pair. Rows that repeat an id count once a pair, with the most covered. A text of any length is whole in one row and one task. Empty tables give no rows.
    """
    seeds = seeds_of(items, item_col, item_text_col, shortest).checkpoint()
    lead = F.shiftrightunsigned("seed", 64 - SEED_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), lead.bitwiseAND(F.lit(63)).cast("int"))
    words = seeds.groupBy("k", F.shiftrightunsigned(lead, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # at most 2**SEED_BITS / 64 rows for each length up to ``shortest``
    tables = {}
    for k, own in words.groupby("k"):
        tables[int(k)] = np.zeros((1 << SEED_BITS) // 64, dtype=np.int64)
        tables[int(k)][own["word"].to_numpy()] = own["bits"].to_numpy()
    packed = docs.sparkSession.sparkContext.broadcast({k: v.tobytes() for k, v in tables.items()})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.unpackbits(np.frombuffer(v, dtype=np.uint8), bitorder="little").astype(bool) for k, v in packed.value.items()}
        for batch in batches:
            for low, high in slices(batch["body"]):
                part = batch.slice(low, high - low)
                hashes, first = tokens(part["body"])
                row_of = np.repeat(np.arange(len(part)), np.diff(first))
                rows, hits = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
                for k, table in bits.items():
                    grams = ngram_hashes(hashes, k)
                    at = np.flatnonzero(table[(grams >> np.uint64(64 - SEED_BITS)).astype(np.int64)] & inside(first, k))
                    rows.append(row_of[at])
                    hits.append(grams[at])
                rows, hits = np.concatenate(rows), np.concatenate(hits)
                with_hits = np.unique(rows)
                if len(with_hits):
                    lists = [np.unique(hits[rows == r]).view(np.int64) for r in with_hits]
                    kept = part.take(pa.array(with_hits))
                    yield pa.RecordBatch.from_arrays([kept["doc"], kept["body"], pa.array(lists, pa.list_(pa.int64()))], names=["doc", "body", "seeds"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("body")).where("doc is not null and body is not null")
    near = texts.mapInArrow(find, "doc long, body string, seeds array<long>").checkpoint()

    found = near.select("doc", F.explode("seeds").alias("seed"))
    counts = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n_docs")).join(seeds.select("seed").distinct(), "seed").checkpoint()
    telling = telling_seeds(seeds.distinct().join(counts, "seed", "left"), percent)
    total = counts.agg(F.sum("n_docs")).first()[0] or 0
    share = max(SALT_ROWS, total // MAX_HOT)
    salts = counts.where(F.col("n_docs") > share).select("seed", F.ceil(F.col("n_docs") / share).cast("int").alias("salts")).checkpoint()  # fewer than MAX_HOT rows
    own, all_ = F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    salted = lambda rows, salt: rows.join(F.broadcast(salts), "seed", "left").withColumn("salt", salt).drop("salts")
    pairs = salted(found, own).join(salted(telling, all_), ["seed", "salt"]).select("doc", "item", "k").distinct()

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                item, doc, k = tokens(one["item_body"])[0], tokens(one["body"])[0], one["k"][0].as_py()
                if k != min(shortest, len(item)) or 100 * _covered(np.isin(ngram_hashes(item, k), ngram_hashes(doc, k)), k) < percent * len(item):
                    continue
                found = tiles(item, doc, k)
                rows.append({"doc_id": one["doc"][0].as_py(), "item_id": one["item"][0].as_py(), "n_item": len(item), "n_covered": sum(t[2] for t in found), "n_tiles": len(found), "tiles": [dict(zip(("item_at", "doc_at", "length"), t, strict=True)) for t in found]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    spans = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_covered", pa.int64()), ("n_tiles", pa.int64()), ("tiles", spans)])
    bodies = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").alias("item_body"))
    both = pairs.join(bodies, "item").join(near.select("doc", "body"), "doc")
    ddl = "doc_id long, item_id long, n_item long, n_covered long, n_tiles long, tiles array<struct<item_at: int, doc_at: int, length: int>>"
    tiled = both.mapInArrow(tile, ddl).where(100 * F.col("n_covered") >= percent * F.col("n_item"))
    best = tiled.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_item", "n_covered", "n_tiles", "tiles"), F.struct("n_covered", "n_item")).alias("s"))
    return best.select("doc_id", "item_id", "s.*")
