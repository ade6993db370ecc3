"""Lines of texts, normalised and sketched: numpy passes over the bytes of bounded blocks of whole lines.

A line is what stands between line feeds. Normalised, it has A-Z lower-cased, runs of white space made one blank
and none at its ends. A block holds at most ``BLOCK`` bytes, or one longer line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .common import mix

BLOCK = 1 << 18
_BASE = int(mix(np.array([20], np.uint64))[0]) | 1
_MULT = mix(np.arange(21, 21 + 64, dtype=np.uint64)) | np.uint64(1)

# White space as Unicode has it: single bytes, then the encodings of two and three bytes, whose lead bytes are 0xC2 and
# beyond.
_WIDE = sorted([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _packed(char: str) -> int:
    return int.from_bytes(char.encode(), "little")


_WIDE2 = np.array([_packed(chr(c)) for c in _WIDE if c < 0x800], np.uint32)
_WIDE3 = np.array([_packed(chr(c)) for c in _WIDE if c >= 0x800], np.uint32)


def _white(part: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = part - np.uint8(0x09) < 5
    white |= part - np.uint8(0x1C) < 5
    at = np.flatnonzero(part >= 0xC2)
    at = at[part[at] <= 0xE3]
    for width, codes in ((2, _WIDE2), (3, _WIDE3)):
        at = at[at + width <= len(part)]
        code = np.zeros(len(at), np.uint32)
        for k in range(width):
            code |= part[at + k].astype(np.uint32) << np.uint32(8 * k)
        for hit in [at[np.isin(code, codes)]]:
            for k in range(width):
                white[hit + k] = True
    return white


@dataclass
class Lines:
    """Normalised lines that are not empty: text row, number in the text, and bytes ``data[cuts[i]:cuts[i + 1]]``."""

    rows: np.ndarray
    numbers: np.ndarray
    data: np.ndarray
    cuts: np.ndarray

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """A code for each character, and the lines' offsets among them."""
        if not len(self.data) or self.data.max() < 0x80:
            return self.data.astype(np.uint64), self.cuts
        follow = (self.data & 0xC0) == 0x80
        codes, at = self.data.astype(np.uint64), np.flatnonzero(follow)
        gone = np.searchsorted(at, self.cuts)
        more = at[at > 0]
        for k in range(1, 4):  # the bytes that follow at distance k
            near = ~follow[more - k]
            codes[more[near] - k] |= self.data[more[near]].astype(np.uint64) << np.uint64(8 * k)
            more = more[~near]
            more = more[more > k]
        return codes[~follow], self.cuts - gone

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` characters (of the whole line, if shorter), and the lines' offsets."""
        codes, cuts = self.characters()
        n = len(codes)
        codes += np.uint64(1)
        # Runs of twice the length are two runs, the second one times a power of the base.
        acc, done, run, long = np.zeros(n, np.uint64), 0, codes.copy(), 1
        while done < min(width, n):
            if width & long:
                acc[: n - done] += run[done:] * np.uint64(pow(_BASE, done, 1 << 64)) if done else run
                done += long
            if 2 * long <= min(width, n):
                run[: n - long] += run[long:] * np.uint64(pow(_BASE, long, 1 << 64))
            long *= 2
        size = np.diff(cuts)
        short = np.flatnonzero(size < width)
        for i in short.tolist():
            own = codes[cuts[i] : cuts[i + 1]]
            acc[cuts[i]] = (own * _MULT[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        keep = np.ones(n, bool)
        for k in range(1, width):
            at = cuts[1:] - k
            keep[at[at > cuts[:-1]]] = False
        if len(short):
            keep[cuts[short]] = True
        return mix(acc[keep]), np.concatenate([[0], np.cumsum(np.maximum(size - width + 1, 1))])


def line_blocks(data: np.ndarray, offs: np.ndarray, block: int = BLOCK) -> Iterator[Lines]:
    """The lines of texts ``data[offs[i]:offs[i + 1]]`` in blocks, in order."""
    feeds = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offs[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    starts = starts[data[starts] != 0x0A]
    rows = np.searchsorted(offs, starts, "right") - 1
    nth = np.searchsorted(feeds, starts)
    numbers = nth - np.searchsorted(feeds, offs[rows])
    ends = np.minimum(np.append(feeds, len(data))[nth], offs[rows + 1])
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block, "right")))
        base = starts[lo]
        part = data[base : ends[hi - 1]]
        part = part + ((part - np.uint8(0x41) < 26).view(np.uint8) << 5)
        white = _white(part)
        # Of each run of white space inside a line its first byte stays, as a blank.
        blank = white.copy()
        blank[1:] &= ~white[:-1]
        runs = np.flatnonzero(blank)
        if len(runs):
            edges = np.concatenate([starts[lo:hi], ends[lo:hi] - 1]) - base
            outer = np.concatenate([edges[white[edges]], feeds[nth[lo] : nth[hi - 1]] - base])
            blank[runs[np.searchsorted(runs, outer, "right") - 1]] = False
        part[white] = 0x20
        keep = ~white
        keep |= blank
        size = np.add.reduceat(keep, starts[lo:hi] - base, dtype=np.int64) if len(part) else np.zeros(0, np.int64)
        full = np.flatnonzero(size)
        if len(full):
            yield Lines(rows[lo:hi][full], numbers[lo:hi][full], part[keep], np.concatenate([[0], np.cumsum(size[full])]))
        lo = hi


__all__ = ["Lines", "line_blocks"]
