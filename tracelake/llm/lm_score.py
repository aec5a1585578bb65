"""Language-model scores by stupid backoff, with counts from the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import arrow_schema, sharded
from .textarrays import bucket_cuts, inside, ngram_hashes, pack_sorted, squeeze, text_words, unpack_sorted, unsqueeze

#: Bytes of text in a shard here: larger shards send fewer distinct n-grams in all.
SHARD = 8_000_000

#: A shard's distinct n-grams of a level with its counts; or (without n-grams) totals that it has been told, sent on.
ASKED = "bucket int, shard int, level int, part int, grams binary, counts binary"
TOLD = "shard int, level int, part int, totals binary"
SCORED = "doc long, n_words long, known double, unigrams long"


class Grams:
    """A shard's n-grams by position, and the totals of those that may reach ``least``.

    Level 2 is all words and pairs. An n-gram of a higher level is asked for only if both (n - 1)-grams in it
    occur ``least`` times or more in the whole table: otherwise it can't either.
    """

    def __init__(self, body: pa.Array, order: int, least: int):
        words, self.first = text_words(body, lower=True)
        self.by_order = [ngram_hashes(words, n) for n in range(1, order + 1)]
        self.fits = [inside(self.first, n) for n in range(1, order + 1)]
        self.totals = [np.zeros(len(g)) for g in self.by_order]
        self.least = least

    def places(self, level: int) -> list[tuple[int, np.ndarray]]:
        """(n, positions) of the n-grams of a level."""
        if level == 2:
            return [(n, np.flatnonzero(self.fits[n - 1])) for n in range(1, min(2, len(self.by_order)) + 1)]
        enough = self.totals[level - 2] >= self.least
        size = len(self.by_order[level - 1])
        return [(level, np.flatnonzero(self.fits[level - 1] & enough[:size] & enough[1 : size + 1]))]

    def distinct(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of a level ascending, which of them each position has, and how often each occurs."""
        return np.unique(np.concatenate([self.by_order[n - 1][at] for n, at in self.places(level)]), return_inverse=True, return_counts=True)

    def learn(self, told: pa.Table, levels: int) -> None:
        """Take in what buckets answered, level by level up to ``levels``."""
        rows = sorted(zip(told["level"].to_pylist(), told["part"].to_pylist(), told["totals"].to_pylist(), strict=True), key=lambda r: r[:2])
        for level in range(2, levels + 1):
            totals = np.concatenate([np.zeros(0, dtype=np.uint64), *(unsqueeze(blob) for own, _, blob in rows if own == level)]).astype(np.float64)
            which, begin = self.distinct(level)[1], 0
            for n, at in self.places(level):
                self.totals[n - 1][at] = totals[which[begin : begin + len(at)]]
                begin += len(at)


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are shuffled once and read by every stage, and make up a third of what is shuffled."""
    pack_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        body = pa.array([None if t is None else pack_.compress(t.encode()) for t in batch["body"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["shard"], batch["doc"], body], names=["shard", "doc", "body"])


def _inflated(column: pa.ChunkedArray) -> pa.Array:
    unpack_ = zstandard.ZstdDecompressor()
    return pa.array([None if b is None else unpack_.decompress(b) for b in column.to_pylist()], pa.binary()).cast(pa.string())


def count_and_score(docs: DataFrame, id_col: str, text_col: str, order: int, alpha: float, min_count: int) -> DataFrame:
    """Per document, the log scores that don't depend on the corpus size, and how many words fell back to their own count."""
    parts, shards = sharded(docs, id_col, text_col, shard_bytes=SHARD, carry=False)
    parts = parts.select("shard", "doc", "body").mapInArrow(_deflate, "shard int, doc long, body binary")
    buckets = shards

    def ask(level: int):
        def run(table: pa.Table, told: pa.Table | None = None) -> pa.Table:
            shard = table["shard"][0].as_py()
            own = Grams(_inflated(table["body"]), order, min_count)
            if told is not None:
                own.learn(told, level - 1)
            seen, _, counts = own.distinct(level)
            cuts = bucket_cuts(seen, buckets)
            full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            rows = [(b, shard, level, b, pack_sorted(seen[cuts[b] : cuts[b + 1]]), squeeze(counts[cuts[b] : cuts[b + 1]])) for b in full]
            if told is not None:
                rows += [((shard + k) % buckets, shard, x["level"], x["part"], None, x["totals"]) for k, x in enumerate(told.to_pylist())]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow_schema(ASKED), strict=True)], schema=arrow_schema(ASKED))

        return run

    def add_up(table: pa.Table) -> pa.Table:
        asked = table.filter(pc.is_valid(table["grams"]))
        sent_on = table.filter(pc.is_null(table["grams"]))
        out = [sent_on.select(["shard", "level", "part", "counts"]).rename_columns(["shard", "level", "part", "totals"])]
        if asked.num_rows:
            grams = [unpack_sorted(x.as_py()) for x in asked["grams"]]
            counts = np.concatenate([unsqueeze(x.as_py()) for x in asked["counts"]])
            _, which = np.unique(np.concatenate(grams), return_inverse=True)
            totals = np.bincount(which, weights=counts).astype(np.uint64)[which]
            blobs = [squeeze(x) for x in np.split(totals, np.cumsum([len(g) for g in grams])[:-1])]
            out.append(asked.select(["shard", "level", "part"]).append_column("totals", pa.array(blobs, pa.binary())))
        return pa.concat_tables([t.cast(arrow_schema(TOLD)) for t in out])

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        own = Grams(_inflated(table["body"]), order, min_count)
        own.learn(told, max(order, 2))
        first, size = own.first, int(own.first[-1])
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        longest = np.minimum(np.arange(size) - first[text] + 1, order)
        value, unscored = np.zeros(size), np.ones(size, dtype=bool)
        for n in range(order, 1, -1):
            begin = np.flatnonzero(own.fits[n - 1] & (own.totals[n - 1] >= min_count) & unscored[n - 1 :])
            end = begin + n - 1
            value[end] = np.log(own.totals[n - 1][begin] / own.totals[n - 2][begin]) + (longest[end] - n) * np.log(alpha)
            unscored[end] = False
        value[unscored] = np.log(own.totals[0][unscored]) + (longest[unscored] - 1) * np.log(alpha)
        known = np.bincount(text, weights=value, minlength=len(first) - 1)
        return pa.table(
            {"doc": table["doc"], "n_words": np.diff(first), "known": known, "unigrams": np.bincount(text[unscored], minlength=len(first) - 1)},
            schema=arrow_schema(SCORED),
        )

    by_shard = parts.groupBy("shard")
    told = by_shard.applyInArrow(lambda table: ask(2)(table), ASKED).groupBy("bucket").applyInArrow(add_up, TOLD)
    for level in range(3, order + 1):
        told = by_shard.cogroup(told.groupBy("shard")).applyInArrow(ask(level), ASKED).groupBy("bucket").applyInArrow(add_up, TOLD)
    return by_shard.cogroup(told.groupBy("shard")).applyInArrow(score, SCORED)


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """The log score of each document under an n-gram model of the whole table.

    Words are lower-cased (A-Z) runs of non-space characters. A word's score is the count of the longest
    n-gram that ends in it and occurs ``min_count`` times or more, over the count of that n-gram without
    the word, times ``alpha`` for each order skipped; with no such n-gram, its own count over the number of
    words in the table. Logs of these are summed per document.

    Count tables are partitioned by the n-gram's hash: each shard of documents sends its distinct n-grams
    with its own counts (so a frequent n-gram is one entry a shard), the bucket of a hash adds them up and
    answers each shard, and the shard joins the answers to its n-grams and sums per document. Pairs and words go first; longer
    n-grams only where all that is in them is frequent enough.

    One row per input row: ``doc_id`` (null stays null), ``n_words``, ``log_score`` (0 without words),
    ``mean_log_score`` (null without words). A null text has no words. Repeated rows are counted as often as
    they occur. A text of any length is whole in one row and one task.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    found = count_and_score(docs, id_col, text_col, order, alpha, min_count).checkpoint()
    total = found.agg(F.sum("n_words")).first()[0] or 1
    score = F.col("known") - F.col("unigrams") * F.log(F.lit(float(total)))
    return found.select(F.col("doc").alias("doc_id"), "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log_score"))
