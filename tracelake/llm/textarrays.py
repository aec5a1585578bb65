"""Words and word hashes of many texts at once, as numpy arrays.

Every function here is a small helper for code inside a Spark task: it gets a slice of an Arrow
batch and gives arrays. Words are maximal runs of bytes other than space and ``\\x09-\\x0D``; as
those are ASCII, cutting the UTF-8 bytes cuts the text in the same places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at a time; each takes about 60 bytes while it is.
BLOCK = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (the splitmix64 finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``block`` bytes; a longer text is a range of its own."""
    at = text_bytes(column)[1]
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + block, side="right")) - 1)
        yield low, min(high, len(column))
        low = high


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and for each text the number of words before it."""
    solid = ~WHITE[data]
    cuts = at[(at > 0) & (at < len(data))]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    before[cuts] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, at)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each span, by prefix sums modulo 2**64."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers_of(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers_of(_INVERSE, len(data) + 1)[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, block by block, so that one huge text takes no more memory than its words."""
    if len(data) <= 2 * BLOCK:
        return _span_hashes(data, starts, ends)
    out, low = np.empty(len(starts), dtype=np.uint64), 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + BLOCK)))
        a, b = starts[low], ends[high - 1]
        out[low:high] = _span_hashes(data[a:b], starts[low:high] - a, ends[low:high] - a)
        low = high
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each position on; the last ``n - 1`` positions are left out."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += words[k : k + size]
    return mix(out + np.uint64(n))


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Positions from which ``n`` words fit into their text; ``first`` is what word_spans gives."""
    total = int(first[-1])
    fits = np.ones(max(total - n + 1, 0), dtype=bool)
    for k in range(1, n):  # the k last positions before each border
        cut = first[1:-1] - k
        fits[cut[(cut >= 0) & (cut < len(fits))]] = False
    return fits


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in as few byte planes as their range takes; Spark's compression gets the rest."""
    if not len(values):
        return b""
    values = values.astype(np.uint64)
    base = values.min()
    rest = values - base
    width = max(1, (int(rest.max()).bit_length() + 7) // 8)
    return np.uint64(base).tobytes() + bytes([width]) + rest.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    width = blob[8]
    planes = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel() + np.frombuffer(blob, dtype=np.uint64, count=1)[0]


def squeeze(values: np.ndarray) -> bytes:
    """pack() for values that are mostly small, deflated."""
    return zlib.compress(pack(values), 1)


def unsqueeze(blob: bytes) -> np.ndarray:
    return unpack(zlib.decompress(blob))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending hashes, as differences."""
    return pack(np.diff(values, prepend=np.uint64(0))) if len(values) else b""


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def bucket_cuts(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of 64-bit values begins in ascending hashes; one more at the end."""
    edges = [min((k << 64) // buckets + 1, (1 << 64) - 1) if k else 0 for k in range(buckets)]
    return np.append(np.searchsorted(ordered, np.array(edges, dtype=np.uint64)), len(ordered))


def text_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column, one after the other, and for each text the number of words before it."""
    hashes, counts = [], [np.zeros(1, dtype=np.int64)]
    for low, high in slices(column):
        data, at = text_bytes(column.slice(low, high - low))
        data = LOWER[data] if lower else data
        starts, ends, first = word_spans(data, at)
        hashes.append(word_hashes(data, starts, ends))
        counts.append(np.diff(first))
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.cumsum(np.concatenate(counts))
