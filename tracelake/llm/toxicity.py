"""A toxicity classifier: character n-grams scaled by naive Bayes log-count ratios, weighed by logistic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .quality import decided
from .shards import nullable
from .textarrays import LOWER, mix, slices, text_bytes

#: Lengths of n-grams in bytes of lower-cased UTF-8; a feature is an n-gram that occurs at least so often in a text.
LENGTHS, LEVELS = (4, 5, 6), (1, 2, 4)
#: Features chosen; how many documents of the sample must have one; parts of the sample that set the threshold in turn.
CHOSEN, SUPPORT, FOLDS = 1024, 3, 3
#: Features of a part of a partition that are counted in one go.
PART = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(3)  # the last two bits of a feature tell the level


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the positions where an n-gram fits into its text and the n-grams' hashes, two bits of which are 0."""
    rolling = np.zeros(len(data), dtype=np.uint64)
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    for n in range(1, max(LENGTHS) + 1):
        size = len(data) - n + 1
        if size <= 0:
            return
        rolling = rolling[:size] * _BASE + data[n - 1 :].astype(np.uint64) + np.uint64(1)
        if n in LENGTHS:
            place = np.flatnonzero(room[:size] >= n)
            yield place, mix(rolling[place] ^ np.uint64(n << 60)) & ~_LEVEL


def feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    for low, high in slices(column):
        data, at = text_bytes(column.slice(low, high - low))
        found = list(grams(LOWER[data], at))
        for a, b in zip(at[:-1], at[1:], strict=True):
            parts = [h[np.searchsorted(place, a) : np.searchsorted(place, b)] for place, h in found]
            own, times = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *parts]), return_counts=True)
            yield np.concatenate([own[times >= least] | np.uint64(k) for k, least in enumerate(LEVELS)])


@dataclass(frozen=True)
class Linear:
    """Weights of the chosen features (ascending) and a bias."""

    chosen: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1: each chosen feature that a text has counts once."""
        if not len(self.chosen):
            return np.full(len(column), 1 / (1 + np.exp(-self.bias)))
        grams_, of = np.unique(self.chosen & ~_LEVEL, return_inverse=True)
        weight = np.zeros((len(grams_), len(LEVELS)))
        weight[of, (self.chosen & _LEVEL).astype(np.int64)] = self.weight
        weight = weight.cumsum(axis=1)  # of a level and those below
        lead = np.zeros(1 << 20, dtype=bool)  # most n-grams are passed over by their leading bits
        lead[(grams_ >> np.uint64(44)).astype(np.int64)] = True
        out = []
        for low, high in slices(column):
            data, at = text_bytes(column.slice(low, high - low))
            text, which = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for place, hashes in grams(LOWER[data], at):
                some = np.flatnonzero(lead[(hashes >> np.uint64(44)).astype(np.int64)])
                k = np.minimum(np.searchsorted(grams_, hashes[some]), len(grams_) - 1)
                hit = grams_[k] == hashes[some]
                which.append(k[hit])
                text.append(np.searchsorted(at, place[some][hit], side="right") - 1)
            pairs, times = np.unique(np.concatenate(text) * len(grams_) + np.concatenate(which), return_counts=True)
            value = weight[pairs % len(grams_), np.searchsorted(LEVELS, times, side="right") - 1]
            out.append(self.bias + np.bincount(pairs // len(grams_), weights=value, minlength=high - low))
        return 1 / (1 + np.exp(-np.concatenate(out))) if out else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """Weights learned from about ``bound`` labelled documents at most.

    Counts of features by label are added up by Spark; of those in SUPPORT documents or more, the CHOSEN ones with the highest log-likelihood ratio of being
    independent of the label come to the driver, and then, for each document, one bit for each of them. The sample is in FOLDS parts by the hash of the text. For each part, features and weights are also
    learned from the other parts alone, and its documents scored with them; the bias of the model is such that a score of 0.5 stands where those scores tell the
    labels with the fewest errors; where they tell nothing, no text gets 0.5. So the threshold doesn't depend on how far a model fits the texts that it was learned from.
    """
    part_of = F.pmod(F.xxhash64("body"), F.lit(FOLDS)).cast("int").alias("fold")
    drawn = sample(docs, labels, label, bound, id_col, text_col).repartition(8, "doc").select("body", "label", part_of).checkpoint()
    sizes = {(x["fold"], x["label"]): x["n"] for x in drawn.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}  # two rows a part
    of_label = lambda label_, without=None: sum(n for (fold, own), n in sizes.items() if own == label_ and fold != without)
    ones, zeros = of_label(1), of_label(0)
    prior = float(np.log((ones + 1) / (zeros + 1)))
    if not ones or not zeros:
        return Linear(np.zeros(0, dtype=np.uint64), np.zeros(0), prior)
    columns = [f"n{label_}{fold}" for label_ in (0, 1) for fold in range(FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        kinds: list[int] = []
        size = 0

        def added() -> pa.RecordBatch:
            found, which = np.unique(np.concatenate(sets), return_inverse=True)
            kind = np.repeat(np.array(kinds), [len(s) for s in sets])
            table = np.bincount(which * len(columns) + kind, minlength=len(found) * len(columns)).reshape(-1, len(columns)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *[pa.array(table[:, k]) for k in range(len(columns))]], names=["gram", *columns])

        for batch in batches:
            for label_, fold, own in zip(batch["label"].to_pylist(), batch["fold"].to_pylist(), feature_sets(batch["body"]), strict=True):
                sets.append(own)
                kinds.append(label_ * FOLDS + fold)
                size += len(own)
                if size >= PART:
                    yield added()
                    sets.clear()
                    kinds.clear()
                    size = 0
        if sets:
            yield added()

    summed = drawn.mapInArrow(count, "gram long, " + ", ".join(f"{c} int" for c in columns)).groupBy("gram").agg(*[F.sum(c).alias(c) for c in columns])
    summed = summed.where(sum((F.col(c) for c in columns), F.lit(0)) >= SUPPORT).coalesce(8).checkpoint()  # of a bounded sample

    def surest(without: int | None) -> DataFrame:
        """The features chosen if a part of the sample is left out, with their log-count ratios."""
        have = lambda label_: sum((F.col(f"n{label_}{fold}") for fold in range(FOLDS) if fold != without), F.lit(0))
        n1, n0 = of_label(1, without), of_label(0, without)
        with1, with0 = F.col("ones"), F.col("zeros")
        have_it = with1 + with0
        cell = lambda n, row, column: F.when(n > 0, n * F.log(n * (n1 + n0) / (row * column))).otherwise(0.0)
        tells = cell(with1, have_it, n1) + cell(with0, have_it, n0) + cell(n1 - with1, n1 + n0 - have_it, n1) + cell(n0 - with0, n1 + n0 - have_it, n0)
        rows = summed.select("gram", have(1).alias("ones"), have(0).alias("zeros")).where(have_it >= SUPPORT)
        ratio = F.log((with1 + 1) * (n0 + 2) / ((with0 + 1) * (n1 + 2)))
        chosen = rows.select("gram", ratio.alias("ratio"), F.round(tells, 6).alias("tells")).orderBy(F.desc("tells"), "gram").limit(CHOSEN)
        return chosen.select(F.lit(-1 if without is None else without).alias("without"), "gram", "ratio")

    parts = [k for k in range(FOLDS) if of_label(1, k) and of_label(0, k) and (sizes.get((k, 1)) or sizes.get((k, 0)))]
    tables = surest(None)
    for k in parts:
        tables = tables.union(surest(k))
    rows = tables.toPandas()  # CHOSEN times FOLDS + 1 rows at most
    if not len(rows):
        return Linear(np.zeros(0, dtype=np.uint64), np.zeros(0), prior)
    all_ = np.unique(rows["gram"].to_numpy().astype(np.int64).view(np.uint64))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(_holds(all_, own)).tobytes() for own in feature_sets(batch["body"])]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch["label"], batch["fold"]], names=["bits", "label", "fold"])

    marked = drawn.mapInArrow(mark, "bits binary, label int, fold int").toArrow().sort_by([("label", "ascending"), ("fold", "ascending"), ("bits", "ascending")])
    packed = np.stack([np.frombuffer(b, dtype=np.uint8) for b in marked["bits"].to_pylist()])
    y, fold = marked["label"].to_numpy().astype(np.float64), marked["fold"].to_numpy()

    def fitted(without: int | None) -> tuple[np.ndarray, np.ndarray, float]:
        own = rows[rows["without"] == (-1 if without is None else without)]
        chosen = own["gram"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(chosen)
        at, use = np.searchsorted(all_, chosen[order]), np.ones(len(y), dtype=bool) if without is None else fold != without
        weight, bias = fit(_bits(packed[use], at, len(all_)), y[use], own["ratio"].to_numpy()[order], float(np.log((y[use].sum() + 1) / ((1 - y[use]).sum() + 1))))
        return at, weight, bias

    margin, scored = np.zeros(len(y)), np.zeros(len(y), dtype=bool)
    for k in parts:
        at, weight, bias = fitted(k)
        margin[fold == k] = _bits(packed[fold == k], at, len(all_)) @ weight + bias
        scored |= fold == k
    at, weight, bias = fitted(None)
    return Linear(all_[at], weight, bias - best_cut(margin[scored], y[scored]))


def _holds(wanted: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of the wanted values (ascending) are among a text's own."""
    place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
    out = np.zeros(len(wanted), dtype=bool)
    out[place[wanted[place] == own]] = True
    return out


def _bits(packed: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """Columns ``at`` of packed bits; a thousand rows are unpacked at a time."""
    parts = [np.unpackbits(packed[k : k + 1000], axis=1, count=count)[:, at].astype(np.float32) for k in range(0, len(packed), 1000)]
    return np.concatenate(parts) if parts else np.zeros((0, len(at)), dtype=np.float32)


def best_cut(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin from which on label 1 is told with the fewest errors; half-way between two that were seen, above all if telling none is best. 0 without both labels."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(-margin, kind="stable")
    gain, ordered = np.cumsum(2 * y[order] - 1), margin[order]
    gain[:-1][ordered[:-1] == ordered[1:]] = -len(y)  # equal margins can't be told apart
    k = int(np.argmax(gain))
    return float(ordered[0]) + 1.0 if gain[k] <= 0 else float(ordered[k] + ordered[min(k + 1, len(y) - 1)]) / 2


def fit(x: np.ndarray, y: np.ndarray, ratio: np.ndarray, prior: float, rounds: int = 300, rate: float = 20.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on bits times log-count ratios, by accelerated gradient steps."""
    scale = (ratio / max(np.sqrt((ratio**2).sum()), 1e-9)).astype(np.float32)
    w, bias, speed, bias_speed = np.zeros(len(ratio)), prior, np.zeros(len(ratio)), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ (w * scale).astype(np.float32) + bias))) - y
        slope = ridge * w + scale * (error.astype(np.float32) @ x) / len(y)
        speed, bias_speed = 0.9 * speed - rate * slope, 0.9 * bias_speed - rate / 40 * error.mean()
        w, bias = w + speed, bias + bias_speed
    return w * scale, float(bias)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, bound: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The probability of label 1 for each whole text, by a linear classifier of character n-grams.

    A feature is whether the text has the n-gram once, twice or four times at least, times the log ratio of its share among documents labelled 1 to that among
    those labelled 0 (naive Bayes); logistic regression weighs the features. Labels of documents that are held out (crc32 of the id) are never
    learned from, and only the text is an input.

    One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if the score reaches ``threshold``). Null and empty texts have the score
    of a text without n-grams. A null id is not held out. Without labels of both kinds every score is the smoothed share of label 1. Repeated
    rows are scored each; an empty table gives no rows; other columns are ignored. A text of any length is whole in one row and one task. N-grams are of bytes of UTF-8, so outside
    ASCII they may cut characters; features that tell labels equally well are chosen in order of their hashes.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, bound, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.value.scores(batch["body"]))], names=["doc_id", "score"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    return decided(texts.mapInArrow(run, "doc_id long, score double"), threshold)


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, bound: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays under ``threshold``; texts are scored where they are read, without a join."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, bound, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(model.value.scores(batch["body"]) < threshold)
            yield batch.select(["row", "body"]).filter(keep)

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(None).cast("int").alias("_"))
    rows = docs.select(rest.alias("row"), F.col(f"`{text_col}`").alias("body"))
    kind = nullable(rows.schema["row"].dataType)
    kept = rows.withColumn("row", F.col("row").cast(kind)).mapInArrow(run, f"row {kind.simpleString()}, body string")
    return kept.select(*[F.col("body").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
