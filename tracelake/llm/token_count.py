"""Greedy word-piece token counts by a longest-match automaton."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import slices, text_bytes, word_hashes, word_spans

#: Distinct words whose counts a task remembers between batches.
REMEMBERED = 400_000
NONE = -1


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file: base64 and a number on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """A trie of pieces with failure links, and how many pieces following a link completes.

    Pieces that begin with a space start a word; the others go on within it. When the automaton can't go on from a node,
    the longest pieces of what it has read are complete: ``popped`` counts them, and ``link`` is the node of what is left,
    which goes on a word. So each byte is read once, and no piece is ever built.
    """

    def __init__(self, pieces: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # node 0 starts a word, node 1 goes on
        whole = [False, False]
        for piece in pieces:
            if not piece:
                continue
            node = 0 if piece.startswith(b" ") else 1
            for byte in piece:
                after = self.next[node].get(byte)
                if after is None:
                    after = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = after
            whole[node] = True
        self.link, self.popped = [NONE] * len(self.next), [0] * len(self.next)
        todo = deque([0, 1])
        while todo:  # shorter strings first
            parent = todo.popleft()
            for byte, node in self.next[parent].items():
                todo.append(node)
                if whole[node]:
                    self.link[node], self.popped[node] = 1, 1
                    continue
                at, extra = self.link[parent], 0
                while at != NONE and byte not in self.next[at]:
                    extra += self.popped[at]
                    at = self.link[at]
                if at != NONE:
                    self.link[node] = self.next[at][byte]
                    self.popped[node] = self.popped[parent] + extra

    def count(self, word: bytes) -> int:
        """Pieces of one word; a word that the pieces can't make up is one unknown token."""
        follow, link, popped = self.next, self.link, self.popped
        node, total = 0, 0
        for byte in b" " + word:
            after = follow[node].get(byte)
            while after is None:
                if link[node] == NONE:
                    return 1
                total += popped[node]
                node = link[node]
                after = follow[node].get(byte)
            node = after
        while node != 1:
            if link[node] == NONE:
                return 1
            total += popped[node]
            node = link[node]
        return total


_made: dict[str, tuple[LongestMatch, dict[int, int]]] = {}


def _automaton(vocabulary: str, pieces: list[bytes]) -> tuple[LongestMatch, dict[int, int]]:
    """The automaton of a vocabulary and the counts of words met before, kept by a Python worker from task to task."""
    if vocabulary not in _made:
        _made.clear()
        _made[vocabulary] = LongestMatch(pieces), {}
    return _made[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and greedy longest-match word-piece tokens of each document, in one scan without any shuffle.

    Words are runs of non-space characters; the first piece of a word is the longest of the vocabulary that matches the word with a
    space before it, and each further piece is the longest that matches what is left. ``vocabulary`` is the path of a rank file, read
    on the driver; its pieces (tens of thousands, whatever the input) are broadcast.

    One row per input row: ``doc_id`` (null stays null), ``n_words``, ``n_tokens``. Null, empty and blank texts have 0 of both. Rows that repeat an id
    are counted each. A text of any length is whole in one row and one task. An empty table gives no rows. Other columns are ignored.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(vocabulary, pieces.value)
        for batch in batches:
            for low, high in slices(batch["body"], 4 << 20):
                data, at = text_bytes(batch["body"].slice(low, high - low))
                starts, ends, first = word_spans(data, at)
                distinct, sample, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                if len(known) > REMEMBERED:
                    known.clear()
                counts = np.empty(len(distinct), dtype=np.int64)
                for k, (word, i) in enumerate(zip(distinct.tolist(), sample.tolist(), strict=True)):
                    n = known.get(word)
                    if n is None:
                        n = known[word] = automaton.count(data[starts[i] : ends[i]].tobytes())
                    counts[k] = n
                sums = np.concatenate([[0], np.cumsum(counts[which])])
                columns = [batch["doc_id"].slice(low, high - low), pa.array(np.diff(first)), pa.array(np.diff(sums[first]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_tokens"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))
    return texts.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
