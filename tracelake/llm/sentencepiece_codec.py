"""Encoding by streaming Viterbi over a sentence-piece vocabulary, and decoding back to the same text."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Distinct segments whose ids a task remembers.
REMEMBERED = 600_000


def read_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, log probability, kind) of a model file; kind is "piece", "byte" or "control".

    The scores of a merge vocabulary are negative ranks; by Zipf's law the piece of rank r has a probability in proportion to 1 / (r + 1).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for k in range(model.vocab_size()):
        kind = "byte" if model.is_byte(k) else "control" if model.is_control(k) or model.is_unknown(k) or model.is_unused(k) else "piece"
        out.append((model.id_to_piece(k), -math.log(1 - min(0.0, model.get_score(k))), kind))
    return out


class Codec:
    """Viterbi encoding that holds only a window of the text, and its inverse."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.root: dict = {}
        self.longest = max([1, *(len(p) for p, _, kind in pieces if kind == "piece")])
        self.bytes_ids = {int(p[1:-1], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = min([0.0, *(s for _, s, kind in pieces if kind == "piece")]) - 10
        for k, (piece, score, kind) in enumerate(pieces):
            if kind == "piece":
                node = self.root
                for letter in piece:
                    node = node.setdefault(letter, {})
                node[""] = (k, score)
        #: Whether no piece goes on past the border between a letter and a space, so that every path has a boundary there.
        self.cut_at_spaces = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, kind in pieces if kind == "piece")
        self.borders = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.mark = np.array([self.bytes_ids[b] for b in SPACE.encode()], dtype=np.int32).tobytes()
        data = [bytes([int(p[1:-1], 16)]) if kind == "byte" else b"" if kind == "control" else p.replace(SPACE, " ").encode() for p, _, kind in pieces]
        self.flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(d) for d in data])])

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation; ties go to the shorter last piece.

        From each boundary the trie gives the pieces that begin there, so scores are held for the longest piece ahead only. Every
        ``window`` boundaries, the best paths to all boundaries that a later path can still come from are compared: the pieces up to where
        they all agree are certain, their ids are committed, and everything before is dropped. So memory holds
        the open window and the ids, however long the text is.
        """
        size, longest, window, unknown, root = len(text), self.longest, 4 * self.longest, self.unknown, self.root
        out: list[int] = []
        base, low = 0, -math.inf
        score, before, ident = [0.0] + [low] * longest, [-1] * (longest + 1), [-1] * (longest + 1)  # by boundary, from base on
        for i in range(size):
            r = i - base
            so_far = score[r]
            score.append(low)
            before.append(-1)
            ident.append(-1)
            node, j, single = root, r, False
            for letter in text[i : i + longest]:
                node = node.get(letter)
                if node is None:
                    break
                j += 1
                hit = node.get("")
                if hit is not None:
                    single = single or j == r + 1
                    total = so_far + hit[1]
                    if total >= score[j]:
                        score[j], before[j], ident[j] = total, i, hit[0]
            if not single and so_far + unknown >= score[r + 1]:
                score[r + 1], before[r + 1], ident[r + 1] = so_far + unknown, i, -1
            if r >= window:
                alive = [k + base for k in range(r + 1, r + 1 + longest) if before[k] >= 0]
                shared = self._commit(text, base, before, ident, alive, out)
                del score[: shared - base], before[: shared - base], ident[: shared - base]
                base = shared
        self._commit(text, base, before, ident, [size], out)
        return out

    def _commit(self, text: str, base: int, before: list[int], ident: list[int], alive: list[int], out: list[int]) -> int:
        """Commit what the paths to all boundaries alive share, and return the last boundary committed."""
        paths = []
        for at in alive:
            path = []
            while at > base:
                path.append(at)
                at = before[at - base]
            paths.append(path[::-1])
        shared = base
        for step in zip(*paths, strict=False):
            if len(set(step)) > 1:
                break
            k = ident[step[0] - base]
            out += [k] if k >= 0 else [self.bytes_ids[b] for b in text[shared : step[0]].encode()]
            shared = step[0]
        return shared

    def segments(self, body: str) -> list[str]:
        """Parts of marked text between which every path is known to converge."""
        return self.borders.findall(body) if self.cut_at_spaces else [body]

    def encode(self, text: str, known: dict[str, bytes]) -> np.ndarray:
        """Ids of a text: a mark goes before it and stands for each space. ``known`` remembers the ids of segments met before.

        A mark that is in the text itself is spelt in bytes, so that it stays apart from a space.
        """
        parts: list[bytes] = []
        for k, part in enumerate(text.split(SPACE) if text else []):
            if k:
                parts.append(self.mark)
            body = part.replace(" ", SPACE)
            for segment in self.segments(body if k else SPACE + body):
                ids = known.get(segment)
                if ids is None:
                    ids = np.array(self.viterbi(segment), dtype=np.int32).tobytes()
                    if len(known) > REMEMBERED:
                        known.clear()
                    if len(segment) <= 64:
                        known[segment] = ids
                parts.append(ids)
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes without the space that encoding put before."""
        ids = np.asarray(ids, dtype=np.int64)
        size = self.at[ids + 1] - self.at[ids]
        place = np.repeat(self.at[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.flat[place].tobytes()[1:].decode("utf-8", errors="replace")


_made: dict[str, tuple[Codec, dict[str, bytes]]] = {}


def _codec(model: str, pieces: list[tuple[str, float, str]]) -> tuple[Codec, dict[str, bytes]]:
    """The codec of a model and the segments it remembers, kept by a Python worker from task to task."""
    if model not in _made:
        _made.clear()
        _made[model] = Codec(pieces), {}
    return _made[model]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("body"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row's whole text, in one scan without any shuffle.

    ``model`` is the path of a model file, read on the driver; its pieces are broadcast. A null text has null ids, an empty one none.
    Row for row: repeated rows give repeated results, an empty table gives none, other columns are ignored.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = _codec(model, pieces.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                ids = [None if text is None else codec.encode(text, known) for text in part["body"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the inverse of encode(); null ids have a null text."""
    pieces = encoded.sparkSession.sparkContext.broadcast(read_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _codec(model, pieces.value)
        for batch in batches:
            texts = [None if ids is None else codec.decode(np.array(ids, dtype=np.int64)) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text in one go: ``doc_id``, ``n_ids``, ``ids_sha256`` (of the ids as little-endian 32-bit values, in
    lowercase hex) and ``same`` (whether decoding gives the text back); with ``keep_ids`` also ``ids``. A null text has nulls in all but ``doc_id``; an empty one has no ids. Row for row: repeated rows
    give repeated results, an empty table gives none, other columns are ignored. A text of any length is whole in one row and one task."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = _codec(model, pieces.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = []
                for text in part["body"].to_pylist():
                    ids = None if text is None else codec.encode(text, known)
                    rows.append((None,) * 4 if ids is None else (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), codec.decode(ids) == text, ids if keep_ids else None))
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names=names)

    kinds = (pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))[: 3 + keep_ids]
    names = ["doc_id", "n_ids", "ids_sha256", "same", "ids"][: 4 + keep_ids]
    ddl = "doc_id long, n_ids long, ids_sha256 string, same boolean" + ", ids array<int>" * keep_ids
    return _texts(docs, id_col, text_col).mapInArrow(run, ddl)
