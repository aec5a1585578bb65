"""Lower-cased words of a text's UTF-8 bytes, some megabytes of it at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are cut into words at a time.
PART = 1 << 22


def _table(*separators: tuple[int, int]) -> bytes:
    """A translation of separators to spaces and of A-Z to a-z."""
    apart = {b for low, high in separators for b in range(low, high + 1)}
    return bytes(32 if b in apart else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Words are runs of anything but ASCII white space; terms are runs of ASCII letters and digits and of all that isn't ASCII.
WORDS = _table((0x20, 0x20), (0x09, 0x0D))
TERMS = _table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def word_parts(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order; no word is cut."""
    tail = b""
    for low in range(0, len(text), PART):
        part = tail + text[low : low + PART].translate(table)
        cut = part.rfind(b" ") + 1 if low + PART < len(text) else len(part)
        yield part[:cut].split()
        tail = part[cut:]
