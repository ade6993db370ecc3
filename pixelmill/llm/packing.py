"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document becomes its token ids and an end id. Documents longer than a sequence are cut into full pieces, the
first of which takes the remainder. What is left to place depends on the histogram of piece lengths alone,
which has at most ``capacity`` entries however large the corpus is, so the plan is made on the driver:

1. enumerate patterns of two and three lengths that fill a sequence exactly;
2. fit their repeat counts to the histogram by non-negative least squares (multiplicative updates), keep the
   strongest ``MOST_PATTERNS``, fit again, round, and never use more pieces of a length than there are;
3. pack the residual best-fit decreasing, moving whole groups of equal sequences at a time.

Pieces of one length are numbered without gaps - counts by (length, salt) first, so that a length that a third
of all pieces share is no single task - and the plan maps number ranges to sequences.

Edge cases: a null or empty text is one piece that holds the end id; rows that repeat a doc_id are packed as
rows of their own; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, cut, text_bytes

CAPACITY, END_ID = 2048, 0
#: Patterns that the plan keeps after the first fit; the rest goes to the residual. It bounds what is sent to the tasks.
MOST_PATTERNS = 8192
#: Distinct words whose ids a task remembers.
MOST_WORDS = 600_000

#: White space but for the blank and the line feed; all of it makes a text take the careful way of splitting.
_OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (0x20, 0x0A)]
_INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")


class _Words(dict):
    """Word to its number; a new word gets the next one and waits for its ids."""

    def __init__(self, owner: WordTokenizer, before: str) -> None:
        self.owner, self.before = owner, before

    def __missing__(self, word: str) -> int:
        o = self.owner
        k = self[word] = len(o.bounds) - 1 + len(o.waiting)
        o.waiting.append(self.before + word)
        return k


def byte_of_char() -> dict[str, int]:
    """The public byte-level spelling: printable Latin-1 characters stand for themselves, the rest for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts, by tokenising each distinct word once.

    The vocabulary's pre-tokeniser always starts a new token at a single blank between two characters that are
    not white space, so a text's ids are those of its parts cut before such blanks, one after another. Words not
    met before are tokenised joined, many at once, and the ids cut again where their bytes add up to a word's.
    Added tokens are cut out first and stand for themselves, as in the tokenizers library. The vocabulary comes from
    the given file of that library; tiktoken, which merges by the same ranks, runs it, and a probe at the start
    compares the two.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        model, byte = Tokenizer.from_file(path), byte_of_char()
        added = model.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"{path} has added tokens that do not stand for themselves alone")
        special = {t.content: i for i, t in added.items()}
        self.special = {t: k for k, t in enumerate(special, 1)}  # the numbers of added tokens among the words
        self.special_ids = list(special.values())
        self.cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")")
        ranks = {bytes(byte[c] for c in w): i for w, i in model.get_vocab().items() if w not in special}
        self.engine = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for w, i in ranks.items():
            self.n_bytes[i] = len(w)
        self.end_id = end_id
        self._clear()
        probe = "".join(["It's a probe:  1234 \u00e4\u00f6 \u4f60\u597d,\n\tnaïve --- WORDS'll do. ", *special, " and so on "])
        if self.encode([probe])[0].tolist()[:-1] != model.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} is not a vocabulary of ranked byte-level merges")

    def _clear(self) -> None:
        self.flat = array("I", [self.end_id, *self.special_ids])
        self.bounds = array("q", range(len(self.flat) + 1))
        self.waiting: list[str] = []
        self.leading, self.spaced = _Words(self, ""), _Words(self, " ")

    def _resolve(self) -> None:
        group: list[str] = []
        for w in self.waiting:
            inner = w[0] == " " and len(w) > 1 and not w[1].isspace() and not w[-1].isspace()
            if group and (not inner or len(group) == 1024):
                self._add(group)
                group = []
            group.append(w)
            if not inner:
                self._add(group)
                group = []
        if group:
            self._add(group)
        self.waiting.clear()

    def _add(self, words: list[str]) -> None:
        ids = self.engine.encode_ordinary("".join(words))
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        stops = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1 + len(self.flat)
        self.flat.extend(ids)
        self.bounds.extend(stops.tolist())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end id after each, and the ``len + 1`` offsets of the texts."""
        if len(self.bounds) > MOST_WORDS:
            self._clear()
        numbers: list[int] = []
        ends = [0]
        first, spaced = self.leading.__getitem__, self.spaced.__getitem__
        for text in texts:
            added = bool(self.special) and any(token in text for token in self.special)
            for t in self.cuts.split(text) if added else [text]:
                if not t:
                    continue
                if added and t in self.special:
                    numbers.append(self.special[t])
                    continue
                odd = "  " in t or "\n " in t or " \n" in t or t[0] == " " or t[-1] == " " or any(c in t for c in _OTHER_SPACES)
                parts = _INNER_BLANK.split(t) if odd else t.split(" ")
                numbers.append(first(parts[0]))
                numbers.extend(map(spaced, parts[1:]))
            numbers.append(0)
            ends.append(len(numbers))
        if self.waiting:
            self._resolve()
        flat, bounds = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.bounds, np.int64)
        num = np.array(numbers, np.int64)
        first_id, count = bounds[num], bounds[num + 1] - bounds[num]
        stop = np.cumsum(count)
        ids = flat[np.repeat(first_id - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.concatenate([[0], stop])[np.array(ends)]


@lru_cache(maxsize=1)
def _tokenizer(path: str, end_id: int) -> WordTokenizer:
    """One for each worker process, whose words later tasks find again."""
    return WordTokenizer(path, end_id)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, end_id)
        for batch in batches:
            _, offs = text_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id")
            for lo, hi in blocks(offs):
                ids, at = tokenizer.encode(batch.column("text").slice(lo, hi - lo).to_pylist())
                n = np.diff(at)
                per = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                head = (n - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                raw = np.ascontiguousarray(ids, "<u4")
                a = at[row] + start
                crc = np.fromiter((zlib.crc32(raw[i:j]) for i, j in zip(a, a + length)), np.int64, len(row))
                cols = [doc_ids.take(pa.array(row + lo)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([a, at[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to one row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return docs.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), schema)


# ---- the plan -----------------------------------------------------------------------------------


def _exact_patterns(have: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of present lengths, largest first, that add up to ``capacity``; 0 stands for no third."""
    present = np.flatnonzero(have)
    present = present[present < capacity]
    ok = np.zeros(capacity + 1, bool)
    ok[present] = True
    out = [np.stack([capacity - b, b, np.zeros_like(b)], 1) for b in [present[(2 * present <= capacity) & ok[capacity - present]]]]
    for c in present[3 * present <= capacity]:
        b = present[(present >= c) & (2 * present + c <= capacity)]
        a = capacity - c - b
        b, a = b[ok[a]], a[ok[a]]
        out.append(np.stack([a, b, np.full_like(a, c)], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _fit(patterns: np.ndarray, hist: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative repeat counts x with (lengths by patterns) x close to the histogram in least squares."""
    target = hist.astype(float)
    target[0] = 0
    x = np.full(len(patterns), max(1e-9, target.sum() / max(1, len(patterns)) / 3))
    up = target[patterns].sum(1)
    for _ in range(rounds):
        made = np.bincount(patterns.ravel(), np.repeat(x, 3), len(hist))
        made[0] = 0
        x *= up / (made[patterns].sum(1) + 1e-9)
    return x


def pack_plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """A histogram of piece lengths (index: length) to patterns and how often each is used; together all pieces."""
    left = hist.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = _exact_patterns(left, capacity)
    if len(patterns):
        x = _fit(patterns, left, 60)
        if len(patterns) > MOST_PATTERNS:
            patterns = patterns[np.argsort(-x, kind="stable")[:MOST_PATTERNS]]
        x = _fit(patterns, left, 200)
        for wanted in (np.floor(x + 0.5), None):  # rounded repeat counts, then what still fits
            for k in np.argsort(-x, kind="stable"):
                p = [int(v) for v in patterns[k] if v]
                most = min(int(left[v]) // p.count(v) for v in p)
                times = most if wanted is None else min(most, int(wanted[k]))
                if times > 0:
                    plan.append((tuple(p), times))
                    for v in p:
                        left[v] -= times
    return plan + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram; equal sequences are moved together."""
    room: list[list[list]] = [[] for _ in range(capacity + 1)]  # by space left: [pattern, count]
    open_ = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(open_[length:])
            if len(fits):
                space = length + int(fits[0])
                group = room[space][-1]
                m = min(n, group[1])
                group[1] -= m
                new = [(*group[0], length), m]
                if not group[1]:
                    room[space].pop()
                    open_[space] = bool(room[space])
                n -= m
            else:
                each = min(n, capacity // length)
                m = n // each
                space, new = capacity, [(length,) * each, m]
                n -= m * each
            rest = capacity - sum(new[0])
            if rest:
                room[rest].append(new)
                open_[rest] = True
            else:
                room[0].append(new)
    return [(tuple(p), m) for groups in room for p, m in groups]


def _ranges(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first numbers of ranges of pieces, what to add for the sequence, and the offset there."""
    used = [0] * (capacity + 1)
    out: dict[int, list[tuple[int, int, int]]] = {}
    seq = 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((used[length], seq - used[length], offset))
            used[length] += times
            offset += length
        seq += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


def _place(ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                at = order[a:b]
                first, add, off = ranges[int(length[at[0]])]
                k = np.searchsorted(first, number[at], "right") - 1
                seq[at], offset[at] = number[at] + add[k], off[k]
            keep = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of ``token_pieces`` with ``sequence_id`` and ``offset``: no gap and no overlap inside a sequence."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.table(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    salts = max(1, pieces.count() // 4096)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = scratch.table(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        hist[r["length"]] = r["n"]
    ranges = _ranges(pack_plan(hist, capacity), capacity)

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("k", F.row_number().over(within) - 1).join(base, ["length", "salt"])
    numbered = numbered.select(*pieces.columns, (F.col("base") + F.col("k")).alias("number"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    placed = numbered.mapInArrow(_place(ranges), schema)
    out = cut(placed)
    scratch.drop()
    return out
