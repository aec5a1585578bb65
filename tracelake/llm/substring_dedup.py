"""Removal of passages that an earlier document has too, confirmed by automata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import arrow_schema, shard_of, sharded
from .textarrays import bucket_cuts, inside, mix, ngram_hashes, pack, pack_sorted, text_words, unpack, unpack_sorted

SEEDS = "bucket int, shard int, seeds binary"
SHARED = "shard int, bucket int, shared binary"
WINDOWS = "bucket int, shard int, hashes binary, docs binary, places binary"
OWNERS = "shard int, docs binary, places binary, owners binary, owner_places binary"
WANTED = "owner long, place int, n_words int, target int"
PASSAGES = "shard int, owner long, passage string"


class Shard:
    """A shard's documents in ascending order of id, as word hashes.

    A place is counted from the first word of the first row that has the id, so that repeated ids stay apart.
    """

    def __init__(self, table: pa.Table, window: int, seed: int):
        table = table.filter(pc.is_valid(table["doc"])).sort_by([("doc", "ascending"), ("body", "ascending")])
        self.words, self.first = text_words(table["body"].combine_chunks())
        self.doc = table["doc"].to_numpy().astype(np.int64)
        self.window, self.seed = window, seed
        self.fits = np.flatnonzero(inside(self.first, window))

    def seeds(self) -> np.ndarray:
        """Of each window, the smallest hash among its runs of ``seed`` words: equal windows have equal seeds, and neighbours often share one."""
        grams = ngram_hashes(self.words, self.seed)
        size = len(self.words) - self.window + 1
        if size <= 0:
            return np.zeros(0, dtype=np.uint64)
        least = grams[:size].copy()
        for k in range(1, self.window - self.seed + 1):
            np.minimum(least, grams[k : k + size], out=least)
        return mix(least[self.fits])  # spread evenly again: least values are small

    def hashes(self) -> np.ndarray:
        return ngram_hashes(self.words, self.window)[self.fits]

    def where(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id and the place within its document of each position."""
        doc = self.doc[np.searchsorted(self.first, at, side="right") - 1]
        return doc, at - self.first[np.searchsorted(self.doc, doc)]


def _firsts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ascending, the first index of each, and which of them each entry is."""
    return np.unique(hashes, return_index=True, return_inverse=True)


def _blobs(schema: str, shard: int, cuts: np.ndarray, **columns) -> pa.Table:
    full = [b for b in range(len(cuts) - 1) if cuts[b] < cuts[b + 1]]
    packed = {name: [put(values[cuts[b] : cuts[b + 1]]) for b in full] for name, (put, values) in columns.items()}
    return pa.table({"bucket": full, "shard": [shard] * len(full)} | packed, schema=arrow_schema(schema))


def passages(parts: DataFrame, shards: int, window: int, seed: int) -> DataFrame:
    """For each shard, the passages that some of its documents may share with a document of a smaller id."""
    buckets = max(1, shards // 2)

    def send_seeds(table: pa.Table) -> pa.Table:
        seeds = np.unique(Shard(table, window, seed).seeds())
        return _blobs(SEEDS, table["shard"][0].as_py(), bucket_cuts(seeds, buckets), seeds=(pack_sorted, seeds))

    def find_shared(table: pa.Table) -> pa.Table:
        """Which seeds occur in two shards or more, as bits in the order in which each shard sent them."""
        lists = [unpack_sorted(x.as_py()) for x in table["seeds"]]
        _, which, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        bits = np.split(counts[which] > 1, np.cumsum([len(x) for x in lists])[:-1])
        return pa.table({"shard": table["shard"], "bucket": table["bucket"], "shared": [np.packbits(x).tobytes() for x in bits]}, schema=arrow_schema(SHARED))

    def send_windows(table: pa.Table, told: pa.Table) -> pa.Table:
        """The first occurrence in this shard of each window whose seed is shared."""
        if not table.num_rows:
            return arrow_schema(WINDOWS).empty_table()
        own = Shard(table, window, seed)
        seeds = own.seeds()
        distinct = np.unique(seeds)
        cuts, shared = bucket_cuts(distinct, buckets), np.zeros(len(distinct), dtype=bool)
        for bucket, bits in zip(told["bucket"].to_pylist(), told["shared"].to_pylist(), strict=True):
            low, high = cuts[bucket], cuts[bucket + 1]
            shared[low:high] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=high - low)
        keep = shared[np.searchsorted(distinct, seeds)] if len(distinct) else np.zeros(0, dtype=bool)
        hashes, first, _ = _firsts(own.hashes()[keep])
        docs, places = own.where(own.fits[keep][first])
        return _blobs(WINDOWS, table["shard"][0].as_py(), bucket_cuts(hashes, buckets), hashes=(pack_sorted, hashes), docs=(pack, _unsigned(docs)), places=(pack, places))

    def find_owners(table: pa.Table) -> pa.Table:
        """For each window sent by a shard, the first place in the document of smallest id, if that id is smaller than the shard's."""
        hashes = [unpack_sorted(x.as_py()) for x in table["hashes"]]
        docs = np.concatenate([unpack(x.as_py()) for x in table["docs"]])
        places = np.concatenate([unpack(x.as_py()) for x in table["places"]])
        sender = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        all_ = np.concatenate(hashes)
        order = np.lexsort((docs, all_))
        begin = np.flatnonzero(np.concatenate([[True], all_[order][1:] != all_[order][:-1]]))
        owner = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
        later = docs[owner] < docs[order]
        entry, owner = order[later], owner[later]
        back = np.argsort(sender[entry], kind="stable")
        entry, owner = entry[back], owner[back]
        cuts = np.searchsorted(sender[entry], np.arange(len(hashes) + 1))
        rows = [k for k in range(len(hashes)) if cuts[k] < cuts[k + 1]]
        cut = lambda values: [pack(values[cuts[k] : cuts[k + 1]]) for k in rows]
        return pa.table(
            {"shard": [table["shard"][k].as_py() for k in rows], "docs": cut(docs[entry]), "places": cut(places[entry]), "owners": cut(docs[owner]), "owner_places": cut(places[owner])},
            schema=arrow_schema(OWNERS),
        )

    def ask(table: pa.Table, told: pa.Table) -> pa.Table:
        """Runs of windows that continue in their owner too, as requests for the owner's passage."""
        if not table.num_rows:
            return arrow_schema(WANTED).empty_table()
        own = Shard(table, window, seed)
        _, first, which = _firsts(own.hashes())
        owner, place = own.where(own.fits[first])
        for x in told.to_pylist():
            docs, places = _signed(unpack(x["docs"])), unpack(x["places"]).astype(np.int64)
            at = own.first[np.searchsorted(own.doc, docs)] + places
            group = which[np.searchsorted(own.fits, at)]
            owner[group], place[group] = _signed(unpack(x["owners"])), unpack(x["owner_places"]).astype(np.int64)
        owner, place = owner[which], place[which]
        doc, _ = own.where(own.fits)
        hit = np.flatnonzero(owner < doc)
        if not len(hit):
            return arrow_schema(WANTED).empty_table()
        at, owner, place = own.fits[hit], owner[hit], place[hit]
        row = np.searchsorted(own.first, at, side="right")
        goes_on = (np.diff(at) == 1) & (np.diff(row) == 0) & (np.diff(owner) == 0) & (np.diff(place) == 1)
        begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        length = np.diff(np.append(begin, len(at))) + window - 1
        wanted = np.unique(np.stack([owner[begin], place[begin], length], axis=1), axis=0)
        return pa.table(
            {"owner": wanted[:, 0], "place": wanted[:, 1].astype(np.int32), "n_words": wanted[:, 2].astype(np.int32), "target": np.full(len(wanted), table["shard"][0].as_py(), dtype=np.int32)},
            schema=arrow_schema(WANTED),
        )

    def answer(table: pa.Table, wanted: pa.Table) -> pa.Table:
        """The words of each passage, from the owner's own text."""
        needed = set(wanted["owner"].to_pylist())
        rows_of: dict[int, list[bytes]] = {}
        for doc, body in zip(table["doc"].to_pylist(), table["body"], strict=True):
            if doc in needed and body.is_valid:
                rows_of.setdefault(doc, []).append(body.as_buffer().to_pybytes())
        texts = {doc: [word for body in sorted(bodies) for word in body.split()] for doc, bodies in rows_of.items()}
        rows = [
            (x["target"], x["owner"], b" ".join(texts[x["owner"]][x["place"] : x["place"] + x["n_words"]]).decode())
            for x in wanted.select(["owner", "place", "n_words", "target"]).to_pylist()
            if x["owner"] in texts
        ]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table(dict(zip(("shard", "owner", "passage"), map(list, columns), strict=True)), schema=arrow_schema(PASSAGES))

    by_shard = parts.groupBy("shard")
    shared = by_shard.applyInArrow(send_seeds, SEEDS).groupBy("bucket").applyInArrow(find_shared, SHARED)
    owners = by_shard.cogroup(shared.groupBy("shard")).applyInArrow(send_windows, WINDOWS).groupBy("bucket").applyInArrow(find_owners, OWNERS)
    wanted = by_shard.cogroup(owners.groupBy("shard")).applyInArrow(ask, WANTED)
    wanted = wanted.withColumn("shard", shard_of(F.col("owner"), shards))
    return by_shard.cogroup(wanted.groupBy("shard")).applyInArrow(answer, PASSAGES)


def _unsigned(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned values of the same order."""
    return (ids.astype(np.int64).view(np.uint64)) ^ np.uint64(1 << 63)


def _signed(values: np.ndarray) -> np.ndarray:
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def _automaton(found: pa.Table):
    """An automaton of the shard's passages, each with its smallest owner, its letters and its words."""
    import ahocorasick

    least: dict[str, int] = {}
    for owner, passage in zip(found["owner"].to_pylist(), found["passage"].to_pylist(), strict=True):
        least[passage] = min(owner, least.get(passage, owner))
    automaton = ahocorasick.Automaton()
    for passage, owner in least.items():
        automaton.add_word(f" {passage} ", (owner, passage.count(" ") + 1))
    automaton.make_automaton()
    return automaton


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, seed: int = 6, layout: bool = False) -> DataFrame:
    """Each document without the words that lie in a passage which a document with a smaller id has too.

    Words are runs of non-space characters, unchanged. A word goes if one of the windows of ``window``
    consecutive words around it also starts in a document of smaller id; windows are judged on the input.

    Five stages visit the shards of documents through one exchange. Seeds (the least hash among the runs of
    ``seed`` words in a window) show which windows can recur at all; the hashes of those windows meet in
    buckets, which tell each shard the smallest document that has them; runs of such windows become requests
    for that document's passage; the passages come back as text. Then each shard compiles an Aho-Corasick
    automaton of its passages and streams all of its documents through it: a word goes only where the text of
    a passage is really found, so a clash of hashes removes nothing. Every message of a shard holds each seed,
    window or passage once, so a passage that all documents share is one entry a shard.

    One row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by
    one space; with ``layout``, a document that loses nothing keeps its text as it is), ``spans`` (begin and end, in words, of what went), ``row`` (the other columns). A null or empty
    text has no words and an empty ``kept``. A row without an id loses nothing and owns nothing. Rows that repeat an id
    are separate documents, neither of them smaller. A text of any length is whole in one row and one task. An empty table gives no rows.
    """
    parts, shards = sharded(docs, id_col, text_col)
    counts = "doc_id long, n_words long, n_removed long, kept string"
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    row = parts.schema["row"].dataType.simpleString()

    def stream(table: pa.Table, found: pa.Table) -> pa.Table:
        schema = arrow_schema(counts).append(pa.field("spans", spans_type)).append(table.schema.field("row"))
        automaton = _automaton(found) if found.num_rows else None
        sizes, removed, kept, spans = [], [], [], []
        for doc, body in zip(table["doc"].to_pylist(), table["body"], strict=True):
            words = body.as_buffer().to_pybytes().split() if body.is_valid else []
            text = b" ".join(words).decode()
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            if automaton is not None and doc is not None and words:
                ends = None
                for at, (owner, n) in automaton.iter(f" {text} "):
                    if owner < doc:
                        ends = np.cumsum([len(w.decode()) + 1 for w in words]) if ends is None else ends
                        last = int(np.searchsorted(ends, at)) + 1
                        cover[last - n] += 1
                        cover[last] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            sizes.append(len(words))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(words[k] for k in np.flatnonzero(~gone)).decode() if len(edges) else body.as_py() if layout else text)
            spans.append([{"begin": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
        return pa.table({"doc_id": table["doc"], "n_words": sizes, "n_removed": removed, "kept": kept, "spans": pa.array(spans, spans_type), "row": table["row"]}, schema=schema)

    found = passages(parts, shards, window, seed)
    return parts.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(stream, f"{counts}, spans array<struct<begin: int, end: int>>, row {row}")
