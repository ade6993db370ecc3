"""Re-Pair grammars over blocks of token ids, and the bytes they are stored as.

``Block`` holds documents as symbols: an id below ``base`` stands for itself, ``base + k`` for the two symbols of rule k.
Building it repeats: count all pairs of neighbours within documents, take the most frequent ones, and replace each of
their occurrences that does not overlap a better one by a new symbol. A round takes all pairs at least a 256th as
frequent as the first, so that a block costs a few sorts. It ends when no pair occurs ``MIN_COUNT`` times, which is when
a rule would cost more than it saves, when symbols of the block's width are used up, or after ``MOST_ROUNDS``.

A block is stored as its head, document ids, symbol and token starts of documents, rules, expansion lengths, symbols.
Lengths allow random access: ``Block.tokens`` finds the symbols that cover a range of a document and expands those alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"REPAIR01"
#: Magic, bytes of the block with the head, base, bytes of a symbol, documents, rules, symbols, tokens.
HEAD = struct.Struct("<8sQIIQQQQ")
MIN_COUNT, SHARE, MOST_ROUNDS = 8, 256, 6
#: Bits of the table that rules most pairs out before they are looked up.
FILTER_BITS = 20


def symbol_width(base: int) -> int:
    """Two bytes where they leave over 15,000 symbols for rules, else four."""
    return 2 if base <= 50_000 else 4


def _pairs(seq: np.ndarray, width: int) -> np.ndarray:
    """A number for each symbol and the next."""
    kind = np.uint32 if width == 2 else np.uint64
    return (seq[:-1].astype(kind) << kind(8 * width)) | seq[1:].astype(kind)


def _slots(codes: np.ndarray) -> np.ndarray:
    kind = codes.dtype.type
    return (codes * kind(0x9E3779B1)) >> kind(codes.dtype.itemsize * 8 - FILTER_BITS)


def _frequent(codes: np.ndarray, none: int, most: int) -> np.ndarray:
    """The pairs that a round replaces, most frequent first; ``none`` is no pair."""
    codes = np.sort(codes)
    codes = codes[: np.searchsorted(codes, none)]
    if not len(codes):
        return codes
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.diff(np.append(first, len(codes)))
    enough = counts >= max(MIN_COUNT, -(-int(counts.max()) // SHARE))
    kinds, counts = codes[first[enough]], counts[enough]
    return kinds[np.argsort(-counts, kind="stable")[:most]]


def _occurrences(codes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen pairs that overlap no better one, and the number of the pair."""
    table = np.zeros(1 << FILTER_BITS, bool)
    table[_slots(chosen)] = True
    at = np.flatnonzero(table[_slots(codes)])
    order = np.argsort(chosen)
    known = chosen[order]
    found = np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)
    hit = known[found] == codes[at]
    at, rank = at[hit], order[found[hit]]
    if not len(at):
        return at, rank
    touch = at[1:] == at[:-1] + 1
    # In a run of one pair, as of "aaaa", every other place is taken.
    head = np.arange(len(at))
    head[1:][touch & (rank[1:] == rank[:-1])] = 0
    key = rank * 2 + ((np.arange(len(at)) - np.maximum.accumulate(head)) & 1)
    win = np.ones(len(at), bool)
    win[1:] &= ~touch | (key[1:] < key[:-1])
    win[:-1] &= ~touch | (key[:-1] < key[1:])
    return at[win], rank[win]


class Block:
    """Documents of token ids under one grammar."""

    def __init__(self, base: int, doc_ids: list[int | None], symbol_starts: np.ndarray, token_starts: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> None:
        self.base, self.doc_ids = base, doc_ids
        self.symbol_starts, self.token_starts = symbol_starts, token_starts  # one more than documents
        self.rules, self.lengths, self.symbols = rules, lengths, symbols

    @classmethod
    def build(cls, base: int, doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray) -> Block:
        """The grammar of documents ``ids[starts[i]:starts[i + 1]]``, none of which is empty."""
        width = symbol_width(base)
        seq = ids.astype(np.uint16 if width == 2 else np.uint32)
        last = np.zeros(len(seq), bool)
        last[starts[1:] - 1] = True
        rules = np.zeros((0, 2), np.int64)
        room = (1 << 8 * width) - 1 - base  # the last symbol stands for no pair
        none = np.iinfo(np.uint32 if width == 2 else np.uint64).max
        rounds = [0]
        for _ in range(MOST_ROUNDS):
            if len(seq) < 2 or len(rules) >= room:
                break
            codes = _pairs(seq, width)
            codes[last[:-1]] = none
            chosen = _frequent(codes, none, room - len(rules))
            if not len(chosen):
                break
            at, rank = _occurrences(codes, chosen)
            used = np.bincount(rank, minlength=len(chosen)) >= MIN_COUNT // 2
            if not used.any():
                break
            number = np.cumsum(used) - 1 + len(rules) + base
            at, rank = at[used[rank]], rank[used[rank]]
            kinds = chosen[used].astype(np.int64)
            rules = np.concatenate([rules, np.stack([kinds >> 8 * width, kinds & ((1 << 8 * width) - 1)], 1)])
            rounds.append(len(rules))
            seq[at] = number[rank]
            last[at] = last[at + 1]
            keep = np.ones(len(seq), bool)
            keep[at + 1] = False
            seq, last = seq[keep], last[keep]
        lengths = np.ones(base + len(rules), np.int64)
        for lo, hi in zip(rounds[:-1], rounds[1:]):  # a round's rules are of symbols of earlier ones
            lengths[base + lo : base + hi] = lengths[rules[lo:hi]].sum(1)
        return cls(base, doc_ids, np.concatenate([[0], np.flatnonzero(last) + 1]), starts, rules, lengths[base:], seq)

    # ---- bytes ----

    def to_bytes(self) -> bytes:
        n = len(self.doc_ids)
        kind = "<u2" if symbol_width(self.base) == 2 else "<u4"
        null = np.fromiter((d is None for d in self.doc_ids), np.uint8, n)
        ids = np.fromiter((0 if d is None else d for d in self.doc_ids), "<i8", n)
        arrays = [ids, null, self.symbol_starts.astype("<i8"), self.token_starts.astype("<i8"), self.rules.astype(kind), self.lengths.astype("<u4"), self.symbols.astype(kind)]
        body = b"".join(a.tobytes() for a in arrays)
        return HEAD.pack(MAGIC, HEAD.size + len(body), self.base, symbol_width(self.base), n, len(self.rules), len(self.symbols), int(self.token_starts[-1])) + body

    @classmethod
    def from_bytes(cls, data: memoryview) -> Block:
        magic, _, base, width, n, n_rules, n_symbols, _ = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        kind = f"<u{width}"
        ids, null = take("<i8", n), take("u1", n)
        return cls(base, [None if z else int(d) for d, z in zip(ids, null)], take("<i8", n + 1), take("<i8", n + 1), take(kind, 2 * n_rules).reshape(-1, 2).astype(np.int64), take("<u4", n_rules).astype(np.int64), take(kind, n_symbols))

    @staticmethod
    def size_of(head: bytes | memoryview, at: int = 0) -> int:
        """Bytes of the block whose head is at ``at``."""
        return HEAD.unpack_from(head, at)[1]

    @classmethod
    def all_in(cls, data: bytes | memoryview) -> Iterator[Block]:
        """The blocks of a file, one after the other."""
        view, at = memoryview(data), 0
        while at < len(view):
            size = cls.size_of(view, at)
            yield cls.from_bytes(view[at : at + size])
            at += size

    # ---- ids ----

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols' ids one after the other, and where each symbol's begin and how many they are."""
        if not hasattr(self, "_flat"):
            size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
            start = np.concatenate([[0], np.cumsum(size)])
            flat = np.empty(start[-1], np.uint32)
            flat[: self.base] = np.arange(self.base)
            at = start.tolist()
            for k, (a, b) in enumerate(self.rules.tolist(), self.base):
                mid = at[k] + at[a + 1] - at[a]
                flat[at[k] : mid] = flat[at[a] : at[a + 1]]
                flat[mid : at[k + 1]] = flat[at[b] : at[b + 1]]
            self._flat, self._start, self._size = flat, start, size
        return self._flat, self._start, self._size

    def ids(self) -> np.ndarray:
        """The ids of all documents."""
        return self._expanded(self.symbols)

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        flat, start, size = self._expansions()
        n = size[symbols]
        stop = np.cumsum(n)
        return flat[np.repeat(start[symbols] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]

    def tokens(self, document: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` of one document; only the symbols that cover them are expanded."""
        own = self.symbols[self.symbol_starts[document] : self.symbol_starts[document + 1]]
        is_rule = own >= self.base
        size = np.ones(len(own), np.int64)
        size[is_rule] = self.lengths[own[is_rule].astype(np.int64) - self.base]
        stop = np.cumsum(size)
        last = int(stop[-1]) if last is None else min(last, int(stop[-1]))
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(stop, first, "right")), int(np.searchsorted(stop, last, "left")) + 1
        head = first - int(stop[a] - size[a])
        out: list[int] = []
        for symbol in own[a:b].tolist():
            stack = [symbol]
            while stack:
                s = stack.pop()
                if s < self.base:
                    out.append(s)
                else:
                    left, right = self.rules[s - self.base].tolist()
                    stack += [right, left]
        return np.array(out[head : head + last - first], np.uint32)
