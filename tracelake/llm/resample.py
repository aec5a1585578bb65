"""Importance resampling towards a target: hashed n-gram features, counted once for each distinct line."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.validate import dense_index
from .bytewords import TERMS, word_parts
from .tables import Tables

#: A line that more than one in HOT of all lines are is met by broadcast; there are fewer than HOT of them.
HOT = 1000


def words_of(text: bytes) -> list[bytes]:
    return [w for part in word_parts(text, TERMS) for w in part]


def buckets_of(words: list[bytes], longest: int, buckets: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words. With ``first`` and ``last``, only of runs that begin before place ``first`` and end from place ``last`` on."""
    crc, out = zlib.crc32, []
    for n in range(1, longest + 1):
        starts = range(len(words) - n + 1) if last is None else range(max(0, last - n + 1), min(first, len(words) - n + 1))
        out += [crc(words[i] if n == 1 else b" ".join(words[i : i + n])) % buckets for i in starts]
    return np.array(out, dtype=np.int32)


def crossing(text: bytes, longest: int, buckets: int) -> np.ndarray:
    """The buckets of the runs of words that cross a newline, each counted at the first newline that it crosses."""
    out = [np.zeros(0, dtype=np.int32)]
    lines = [w for line in text.split(b"\n") if (w := words_of(line))]
    for k, line in enumerate(lines[:-1]):
        head, more = line[max(0, len(line) - longest + 1) :], []
        for after in lines[k + 1 :]:
            more += after[: longest - 1 - len(more)]
            if len(more) >= longest - 1:
                break
        out.append(buckets_of(head + more, longest, buckets, len(head), len(head)))
    return np.concatenate(out)


def _key(line: str | Column) -> Column:
    """128 bits that name a line."""
    return F.unhex(F.md5(F.col(line).cast("binary") if isinstance(line, str) else line.cast("binary")))


def _lines(body: str) -> Column:
    """The lines of a text that have any word."""
    return F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))


def line_features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(key, held, words, found): how often each distinct line of the texts (doc, body) occurs, its number of words and its features as buckets."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(x.as_buffer().to_pybytes()) for x in batch["line"]]
            found = _lists([buckets_of(x, longest, buckets) for x in words])
            yield pa.RecordBatch.from_arrays([batch["key"], batch["held"], pa.array([len(x) for x in words], pa.int64()), found], names=["key", "held", "words", "found"])

    lines = texts.select(F.explode(_lines("body")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("held"))
    named = lines.select(_key("line").alias("key"), "held", F.col("line").cast("binary").alias("line"))
    return named.mapInArrow(hashed, "key binary, held long, words long, found array<int>")


def text_keys(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(row, doc, keys, found): the lines of each text (doc, body) by their keys, and the features that cross newlines."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [crossing(x.as_buffer().to_pybytes() if x.is_valid else b"", longest, buckets) for x in batch["body"]]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc"], batch["keys"], _lists(found)], names=["row", "doc", "keys", "found"])

    keys = texts.select(F.monotonically_increasing_id().alias("row"), "doc", F.transform(_lines("body"), _key).alias("keys"), F.col("body").cast("binary").alias("body"))
    if longest == 1:
        return keys.select("row", "doc", "keys", F.array().cast("array<int>").alias("found"))
    return keys.mapInArrow(hashed, "row long, doc long, keys array<binary>, found array<int>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(x) for x in arrays]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *arrays])))


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in (held, found), with repeats; one vector of fixed length for each task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            times = np.repeat(batch["held"].to_numpy(), batch["found"].value_lengths().to_numpy())
            np.add.at(total, batch["found"].flatten().to_numpy(), times)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in found.select("held", "found").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share of a bucket in the target over that in the source)."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(all_source + n) / (float(s + 1) * float(all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(found: DataFrame, gain: np.ndarray, *keep: str) -> DataFrame:
    """(keep, size, weight): the number of buckets in ``found``, and the sum of their gains."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["found"].value_lengths().to_numpy().astype(np.int64)
            sums, at = np.concatenate([[0], np.cumsum(gain[batch["found"].flatten().to_numpy()])]), np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(sizes), pa.array(sums[at[1:]] - sums[at[:-1]])], names=[*keep, "size", "weight"])

    kinds = dict(found.dtypes)
    return found.select(*keep, "found").mapInArrow(weigh, ", ".join([*[f"{c} {kinds[c]}" for c in keep], "size long, weight long"]))


def text_sums(rows: DataFrame, lines: DataFrame, gain: np.ndarray, tables: Tables) -> DataFrame:
    """(row, doc, words, size, weight) of each text: sums over its lines and over what crosses them.

    The features of very common lines are broadcast; their number is bounded by HOT.
    """
    by_line = tables.keep(weighed(lines, gain, "key", "held", "words"))
    most = (by_line.agg(F.sum("held")).first()[0] or 0) / HOT
    sums = F.struct("words", "size", "weight").alias("sums")
    hot = F.broadcast(by_line.where(F.col("held") > most).select("key", sums))
    met = rows.select("row", F.explode("keys").alias("key")).join(hot, "key", "left")
    rest = met.where("sums is null").select("row", "key").join(by_line.where(F.col("held") <= most).select("key", sums), "key")
    across = weighed(rows.where("size(found) > 0"), gain, "row").select("row", F.struct(F.lit(0).cast("long").alias("words"), "size", "weight").alias("sums"))
    parts = met.where("sums is not null").select("row", "sums").union(rest.select("row", "sums")).union(across)
    total = parts.groupBy("row").agg(*[F.sum(f"sums.{c}").alias(c) for c in ("words", "size", "weight")])
    return rows.select("row", "doc").join(total, "row", "left").na.fill(0, ["words", "size", "weight"])


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Documents weighed by how much likelier their features are in ``target``, and ``percent`` of them drawn without replacement by Gumbel noise.

    Words are runs of ASCII letters and digits and of all that isn't ASCII, A-Z lower-cased. Features are all runs of 1 to ``longest`` words, joined by a
    space, repeats counted, hashed to ``buckets`` by CRC-32. Texts are cut at newlines: features within lines are counted once for each distinct line, times
    its occurrences, and once more weighed once; those that cross newlines are added document by document. A bucket's gain is floor(1000 ln(((t + 1) /
    (T + buckets)) / ((s + 1) / (S + buckets)))) of its counts in target and documents. Of the documents with ``least_words`` words or more, the
    floor of ``percent`` % with the highest scores are drawn: score is the weight and floor(-1000 ln(-ln((h + 0.5) / 2^32))), h being the first 8 hex
    digits of sha256("seed:id").

    One row per row of ``docs``: doc_id, n_features, weight, score, rank (from 1 in order of score, ties to the smaller id; null if not drawn). Null and
    empty texts have no features and weight 0. Rows without an id have a null score and are never drawn, but their features count. Rows that repeat an id are
    documents of their own with the same noise; if their scores are equal too, those with more features, then any, come first. A line, and for ``longest`` over 1 a text, is
    whole in one task. Empty tables give no rows, or counts of 0 of the target. Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("body"))
    aim = target.select(F.lit(None).cast("long").alias("doc"), F.col(f"`{target_col}`").alias("body"))
    counts, kept = [], []
    for texts in (source, aim):
        lines = tables.keep(line_features(texts, longest, buckets))
        rows = tables.keep(text_keys(texts, longest, buckets)) if texts is source or longest > 1 else None
        across = 0 if longest == 1 else bucket_counts(rows.select(F.lit(1).cast("long").alias("held"), "found"), buckets)
        counts.append(bucket_counts(lines, buckets) + across)
        kept.append((rows, lines))
    scored = text_sums(*kept[0], gains(*counts), tables)
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0))).cast("long")
    scored = tables.keep(scored.withColumn("score", F.col("weight") + noise))
    fit = scored.where(F.col("doc").isNotNull() & (F.col("words") >= least_words)).select("row", "doc", "size", "score")
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.col("doc"), F.desc("size"), F.col("row")]
    ranked = dense_index(fit, *order, name="place", window_rows=0).where(F.col("place") < drawn).select("row", (F.col("place") + 1).alias("rank"))
    out = scored.join(ranked, "row", "left").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_features"), "weight", "score", "rank").checkpoint()
    tables.drop()
    return out
