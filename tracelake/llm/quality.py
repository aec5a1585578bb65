"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .textarrays import mix, slices, text_bytes, word_hashes, word_spans

#: Classes of bytes whose shares are features.
KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "mark", "pipe", "symbol", "other", "beyond")
_KIND = np.full(256, KINDS.index("other"), dtype=np.int64)
_KIND[128:] = KINDS.index("beyond")
for _kind, _letters in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t"), ("newline", b"\n\r"), ("stop", b".,;:"), ("mark", b"!?"), ("pipe", b"|"), ("symbol", b"#$%&*@^~+=<>{}[]\\/_")):
    _KIND[list(_letters)] = KINDS.index(_kind)
_NEWLINE = ord("\n")

FEATURES = (*KINDS, "log_words", "word_bytes", "long_words", "short_words", "distinct_words", "top_word", "log_lines", "line_words", "distinct_lines", "top_line")


def _repeats(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its distinct items and the count of its commonest one."""
    rows = len(first) - 1
    text = np.repeat(np.arange(rows), np.diff(first))
    keys = mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    own = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
    counts, of = np.diff(np.append(begin, len(own))), text[order][begin]
    most = np.zeros(rows)
    np.maximum.at(most, of, counts)
    return np.bincount(of, minlength=rows).astype(np.float64), most


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, FEATURES) of whole texts; a null or empty text has zeros."""
    out = []
    for low, high in slices(column):
        data, at = text_bytes(column.slice(low, high - low))
        size, rows = np.diff(at), high - low
        text = np.repeat(np.arange(rows), size)
        kinds = np.bincount(text * len(KINDS) + _KIND[data], minlength=rows * len(KINDS)).reshape(rows, -1) / np.maximum(size, 1)[:, None]
        starts, ends, first = word_spans(data, at)
        words, length = np.diff(first), ends - starts
        of_word = np.repeat(np.arange(rows), words)
        per_word = lambda values: np.bincount(of_word, weights=values, minlength=rows) / np.maximum(words, 1)  # noqa: E731, B023
        distinct, top = _repeats(word_hashes(data, starts, ends), first)
        edge = data == _NEWLINE
        line_start = np.zeros(len(data), dtype=bool)
        line_start[1:] = edge[:-1]
        line_start[at[:-1][size > 0]] = True
        begins = np.flatnonzero(line_start & ~edge)
        breaks = np.append(np.flatnonzero(edge), len(data))
        stops = np.minimum(breaks[np.searchsorted(breaks, begins)], at[np.searchsorted(at, begins, side="right")]) if len(begins) else begins
        first_line = np.searchsorted(begins, at)
        lines = np.diff(first_line)
        distinct_lines, top_line = _repeats(word_hashes(data, begins, stops), first_line)
        some = np.maximum(words, 1)
        out.append(
            np.column_stack(
                [kinds, np.log1p(words), per_word(length), per_word(length > 12), per_word(length <= 3), distinct / some, top / some]
                + [np.log1p(lines), words / np.maximum(lines, 1), distinct_lines / np.maximum(lines, 1), top_line / np.maximum(lines, 1)]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth, flattened: node n has the children 2n + 1 and 2n + 2."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # go right if the value is greater
    leaf: np.ndarray  # trees x leaves
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: all rows go down a tree at once."""
        total, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[row, feature[node]] > limit[node])
            total += leaf[node - len(limit)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Gradient boosting of the log loss. Values are put into ``bins`` quantile bins once; splits come from sums of gradients by bin."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Forest(np.zeros((0, 2**depth - 1), dtype=np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), float(np.log(share / (1 - share))))
    edges = np.quantile(x, np.arange(1, bins) / bins, axis=0)
    binned = np.stack([np.searchsorted(edges[:, f], x[:, f]) for f in range(x.shape[1])], axis=1)
    n_features, share = x.shape[1], y.mean()
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    all_feature, all_limit, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)  # within its level
        feature, limit = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            nodes = 2**level
            g, h = np.zeros((nodes, n_features, bins)), np.zeros((nodes, n_features, bins))
            for f in range(n_features):
                key = node * bins + binned[:, f]
                g[:, f] = np.bincount(key, gradient, nodes * bins).reshape(nodes, bins)
                h[:, f] = np.bincount(key, weight, nodes * bins).reshape(nodes, bins)
            gl, hl = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
            gt, ht = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            choice = gain.reshape(nodes, -1).argmax(axis=1)
            worth = gain.reshape(nodes, -1)[np.arange(nodes), choice] > 1e-9
            f, b = choice // (bins - 1), choice % (bins - 1)
            at = nodes - 1 + np.arange(nodes)
            feature[at], limit[at] = np.where(worth, f, 0), np.where(worth, edges[b, f], np.inf)
            node = 2 * node + (worth[node] & (binned[np.arange(len(y)), f[node]] > b[node]))
        leaf = rate * np.bincount(node, gradient, 2**depth) / (np.bincount(node, weight, 2**depth) + ridge)
        total += leaf[node]
        all_feature.append(feature)
        all_limit.append(limit)
        all_leaf.append(leaf)
    return Forest(np.array(all_feature), np.array(all_limit), np.array(all_leaf), start)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Trees fitted on the statistics of about ``bound`` labelled documents at most; only their FEATURES come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(batch["body"]).ravel()), len(FEATURES))
            yield pa.RecordBatch.from_arrays([x.cast(pa.list_(pa.float64())), batch["label"]], names=["x", "label"])

    rows = sample(docs, labels, label, bound, id_col, text_col).mapInArrow(run, "x array<double>, label int").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows came in
    return fit(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, bound: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The probability of label 1 for each whole text, by trees learned from ``labels``.

    Only statistics of the text are inputs: shares of kinds of bytes, lengths, repeated words and lines. Labels of documents that are
    held out (crc32 of the id) are never learned from.

    One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if the score reaches ``threshold``). Null and empty texts are
    scored as texts without bytes. A null id is not held out. Without usable labels every score is the prior 0.5. Repeated rows are scored each; an
    empty table gives no rows; other columns are ignored. A text of any length is whole in one row and one task.
    """
    forest = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, bound, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(forest.value.scores(statistics(batch["body"])))], names=["doc_id", "score"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    return decided(texts.mapInArrow(run, "doc_id long, score double"), threshold)


def decided(scored: DataFrame, threshold: float) -> DataFrame:
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
