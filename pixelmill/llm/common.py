"""What the operators of this subpackage share: cutting lineage, and byte, word and shingle kernels.

Kernels work on Arrow string columns as one byte array plus offsets, so that a batch of documents costs a
fixed number of numpy passes. Nulls count as empty texts everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pixelmill.runtime import settled as cut
from pixelmill.runtime import shared_folder, ship, unused

#: Bytes of text that a kernel works on at once; a longer document is worked on alone.
BLOCK_BYTES = 2_000_000
#: Whether the shuffle files of a write go when it ends; no later plan reads those of a written table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ---- lineage ------------------------------------------------------------------------------------


#: Places, and entries of their lists, up to which they are sent to the texts instead of the texts to them.
FEW_PLACES, FEW_ENTRIES = 100_000, 500_000


def by_place(docs: DataFrame, places: DataFrame, columns: list[str], wanted: list[str]) -> DataFrame:
    """``columns`` of ``docs(doc_id, text_hash, ...)`` and ``wanted`` of those ``places(doc_id, text_hash, ...)`` that are
    there, once each: of rows that repeat a place one is taken. A null id is a place's, too.

    Few places are broadcast, after a look at their number, so that no other text is shuffled for them.
    """
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("text_hash").alias("_hash")]
    names = ["_id", "_none", "_hash"]
    places = cut(places.select(*keys, *wanted))
    lists = [F.sum(F.size(f.name)) for f in places.schema if isinstance(f.dataType, ArrayType)]
    n, *entries = places.agg(F.count("*"), *lists).first()
    few = n <= FEW_PLACES and all((e or 0) <= FEW_ENTRIES for e in entries)
    found = docs.select(*keys, *columns).join(F.broadcast(places) if few else places, names)
    return found.groupBy(*names).agg(*[F.first(c).alias(c) for c in [*columns, *wanted]]).drop(*names)


class Scratch:
    """Parquet tables in the shared folder that live as long as one call of an operator.

    ``drop`` removes a table once no later job of the call reads it.
    """

    def __init__(self, spark: SparkSession) -> None:
        ship(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/pixelmill-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def table(self, df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
        """``df`` written and read again; columns of hashes, which hardly repeat, are written sooner without a ``dictionary``."""
        path = f"{self.root}/{name}"
        conf = self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        finally:
            conf.set(CLEANUP, before)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, *names: str) -> None:
        for name in self.names.difference(names):
            self.drop(name)
        self.names &= set(names)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# ---- bytes --------------------------------------------------------------------------------------


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes as one array, and ``len + 1`` offsets into it; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together, or of one document."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


# ---- words and shingles -------------------------------------------------------------------------

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        a = np.full(size, base, np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if size <= 4 * BLOCK_BYTES:
            _pow[base] = have
    return have[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    t = h >> np.uint64(30)
    h ^= t
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(h, np.uint64(27), out=t)
    h ^= t
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=t)
    h ^= t
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``data[start:end]``, by polynomial prefix sums."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INV, n + 1)[starts])


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document (plus one) the number of its first word."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True  # documents never share a word
    body = solid[1:-1]
    starts = np.flatnonzero(body & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(body & (~solid[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


_MULT = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words (with fewer words, of the whole sequence), and each one's document."""
    counts = np.diff(firsts)
    n = len(words)
    doc_of_word = np.repeat(np.arange(len(counts)), counts)
    if n >= width:
        acc = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            acc += words[k : n - width + 1 + k] * _MULT[k]
        keep = doc_of_word[: n - width + 1] == doc_of_word[width - 1 :]
        full, docs = mix(acc[keep]), doc_of_word[: n - width + 1][keep]
    else:
        full, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += words[firsts[short[has]] + k] * _MULT[k]
        extra = mix(extra, 1) + counts[short].astype(np.uint64)
        full, docs = np.concatenate([full, extra]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        full, docs = full[order], docs[order]
    return full, docs


def distinct(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of each ``hashes[cuts[i]:cuts[i + 1]]`` sorted and once, and their offsets; sorts in place."""
    keep = np.zeros(len(hashes), bool)
    size = np.zeros(len(cuts) - 1, np.int64)
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if b > a:
            s = hashes[a:b]
            s.sort()
            new = keep[a:b]
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            size[i] = np.count_nonzero(new)
    return hashes[keep], np.concatenate([[0], np.cumsum(size)])


def set_keys(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of 128 bits, as two words, of each set of elements ``hashes[cuts[i]:cuts[i + 1]]``."""
    out = []
    for seed in (101, 102):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes, seed))])
        out.append(mix(sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
    return out[0], out[1]


def word_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks ``lo, hi`` of texts with the distinct hashes of their lower-cased word shingles, sorted by text."""
    data, offs = text_bytes(column)
    for lo, hi in blocks(offs):
        part, own = LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        starts, ends, firsts = word_spans(part, own)
        hashes, docs = shingle_hashes(span_hashes(part, starts, ends), firsts, width)
        yield lo, hi, *distinct(hashes, np.searchsorted(docs, np.arange(hi - lo + 1)))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text in turn, the sorted distinct hashes of its lower-cased word shingles."""
    for lo, hi, hashes, cuts in word_sets(column, width):
        for i in range(hi - lo):
            yield lo + i, hashes[cuts[i] : cuts[i + 1]]


__all__ = ["BLOCK_BYTES", "LOWER", "Scratch", "blocks", "by_place", "cut", "distinct", "mix", "set_keys", "shared_folder", "shingle_hashes", "shingle_sets", "span_hashes", "text_bytes", "unused", "word_sets", "word_spans"]
