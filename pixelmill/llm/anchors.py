"""Anchored pieces of texts: what spreads equal substrings of a fixed length to common places.

Every window of ``length`` bytes has an anchor, its run of ``GRAM`` bytes with the smallest hash (the leftmost of
equal ones). Equal windows have equal anchors at equal offsets, so only windows with one anchor hash need
comparison. Windows that share one place of the text as their anchor follow each other; they and their bytes are a
piece. A piece is known by its anchor's hash, and by a hash of its content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix

GRAM = 32
#: Windows that a kernel works on at once.
BLOCK = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` bytes, put together from runs of powers of two."""
    parts, h, size, at = [], data.astype(np.uint64) + np.uint64(1), 1, length
    while True:
        if at & 1:
            parts.append((size, h))
        at >>= 1
        if not at:
            break
        m = mix(np.array([size], np.uint64), 3)[0] | np.uint64(1)
        h = h[: len(h) - size] * m + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    n = len(data) - length + 1
    out, place = np.zeros(n, np.uint64), 0
    for size, h in reversed(parts):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[place : place + n]
        out ^= out >> np.uint64(29)
        place += size
    return mix(out)


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def pieces(data: np.ndarray, offs: np.ndarray, length: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of pieces: document, first window's start there, number of windows, anchor hash, content hash."""
    n = len(data)
    for lo in range(0, max(0, n - length + 1), BLOCK):
        part = data[lo : lo + BLOCK + length - 1]
        grams = window_hashes(part, gram)
        # Hash first, place second: the smallest is the leftmost of the smallest hashes.
        packed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_window_least(packed, length - gram + 1) & _POSITION).astype(np.int64)
        whole = window_hashes(part, length)
        start = np.arange(len(anchor)) + lo
        doc = np.searchsorted(offs, start, "right") - 1
        inside = start + length <= offs[doc + 1]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & inside)
        if not len(first):
            continue
        # A document's windows inside it come first, so a piece's windows inside are a prefix of its run.
        stop = np.concatenate([np.flatnonzero(new)[1:], [len(anchor)]])[np.cumsum(new)[first] - 1]
        d = doc[first]
        count = np.minimum(stop, offs[d + 1] - length + 1 - lo) - first
        last = first + count - 1
        content = mix(whole[first] * np.uint64(3) + whole[last] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (anchor[first] - first).astype(np.uint64), 7)
        yield d, start[first] - offs[d], count, grams[anchor[first]], content
