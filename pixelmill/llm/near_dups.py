"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round ``i < t`` every shingle falls into one hashed bin of
``t``; in round ``t + j`` every shingle falls into bin ``j``. A bin keeps the smallest (round, value). Rounds
stop once all bins of a document are full, which most texts reach in one or two, and every coordinate is sure
to be full after ``2 t``.

Documents with equal shingle sets are one class, known by 128 bits of hash; ``set_links`` compares and connects the
classes.

Edge cases: null and empty texts, and texts of white space only, have no shingles, are linked with nothing and
stay, as their own component. Rows that repeat a doc_id are judged by their own text. A null doc_id never wins
a component while another id is there. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_place, cut, mix, set_keys, shingle_sets, unused, word_sets
from .set_links import SIGNS, SIGNS_SCHEMA, set_components, signs

WIDTH, BINS, ROWS = 5, 100, 5
_FULL = np.uint64(2**64 - 1)
MANY = 1 << 15  # elements of a round, or of several together


def sketch(hashes: np.ndarray, docs: np.ndarray, n_docs: int, t: int = BINS) -> np.ndarray:
    """Fast similarity sketches of ``n_docs`` sets given as (hash, document) elements, ``n_docs`` by ``t``."""
    out = np.full((n_docs, t), _FULL, np.uint64)
    flat = out.reshape(-1)
    h, d = hashes, docs.astype(np.int64)
    at, rest, still = d * t, np.arange(n_docs), np.zeros(n_docs, bool)
    step = mix(np.arange(2 * t, dtype=np.uint64)) | np.uint64(1)
    i = 0
    while i < 2 * t and len(h):
        # Few elements take several rounds at once: of a bin's values that of the earliest round is the least.
        last = min(2 * t, i + max(1, MANY // len(h)) if i else 1)
        rounds = np.arange(i, last, dtype=np.uint64)[:, None]
        x = h * step[i:last, None] if i else h[None]  # hashes come mixed: the high half chooses the bin, the low half is the value
        bins = x >> np.uint64(32)
        bins *= np.uint64(t)
        bins >>= np.uint64(32)
        bins[max(t - i, 0) :] = rounds[max(t - i, 0) :] - np.uint64(t)
        place = bins.view(np.int64)
        place += at
        value = x & np.uint64(0xFFFFFFFF)
        value |= rounds << np.uint64(32)
        place, value = place.reshape(-1), value.reshape(-1)
        if i:  # what is full has a value of an earlier round
            empty = np.flatnonzero(flat[place] == _FULL)
            place, value = place[empty], value[empty]
        np.minimum.at(flat, place, value)
        i = last
        full = (out[rest] != _FULL).all(axis=1)
        if full.any():
            rest = rest[~full]
            still[:] = False
            still[rest] = True
            todo = still[d]
            h, d, at = h[todo], d[todo], at[todo]
    return out


def _bands(sk: np.ndarray, rows: int) -> np.ndarray:
    n, t = sk.shape
    acc = np.zeros((n, t // rows), np.uint64)
    for r in range(rows):
        acc = mix(acc + sk[:, r::rows], r + 11)
    return acc + np.arange(t // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


_SKETCH = "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bands binary, " + SIGNS_SCHEMA


def band_lists(sk: np.ndarray, rows: int, has: np.ndarray) -> pa.Array:
    """The bands of each sketch, packed, and nothing where ``has`` is false."""
    bands = _bands(sk[has], rows)
    ends = np.concatenate([[0], np.cumsum(np.where(has, bands.shape[1] * 8, 0))]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(ends), pa.py_buffer(bands)])


def _sketches(width: int, bins: int, rows: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.select(["doc_id", "text_hash"])
            for lo, hi, h, cuts in word_sets(batch.column("text"), width):
                size = np.diff(cuts)
                k1, k2 = set_keys(h, cuts)
                bands = band_lists(sketch(h, np.repeat(np.arange(hi - lo), size), hi - lo, bins), rows, size > 0)
                own = [*who.slice(lo, hi - lo).columns, pa.array(size), pa.array(k1), pa.array(k2), bands, *signs(h, cuts)]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands", *SIGNS])

    return run


def near_rows(docs: DataFrame, percent: int = 85, width: int = WIDTH, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, text)`` to one row per row: ``doc_id, text_hash, n_shingles, component_id, first``.

    ``first`` tells the row of its component that comes first by (doc_id, text_hash), nulls last; rows that repeat
    both are first together.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketched = scratch.table(docs.mapInArrow(_sketches(width, bins, rows), _SKETCH), "sketched")
    sk = scratch.table(sketched.drop("bands", *SIGNS), "sets")
    full = sk.where("n_shingles > 0")

    # A class of equal sets is a node, known by the first word of its key; should two classes share that, the one with
    # the smaller second word is the node and the other is linked with nothing.
    place = F.struct("k2", F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    classes = scratch.table(full.groupBy("k1").agg(F.min(place).alias("at")).select(F.col("k1").alias("c"), "at.*"), "classes")

    def describe(wanted: DataFrame) -> DataFrame:
        return by_place(docs, classes.join(wanted, "c"), ["text"], ["c"])

    nodes = sketched.where("n_shingles > 0").select(F.col("k1").alias("c"), "bands", *SIGNS)
    comp = set_components(nodes, describe, partial(shingle_sets, width=width), percent, bins // rows, scratch, "sketched")
    comp = comp.join(classes.select("c", "k2"), F.col("node") == F.col("c")).select(F.col("node").alias("k1"), "k2", "comp")

    # The first row of each component, and so back to the rows.
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    named = full.groupBy("k1", "k2").agg(F.min(row).alias("own")).join(comp, ["k1", "k2"], "left")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("own").alias("least"))
    named = named.join(least, "comp", "left").select("k1", "k2", F.coalesce("least", "own").alias("least"))
    rows_out = full.join(named, ["k1", "k2"]).select("doc_id", "text_hash", "n_shingles", F.col("least.doc_id").alias("component_id"), (row == F.col("least")).alias("first"))
    alone = sk.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    out = cut(rows_out.unionByName(alone))
    scratch.drop()
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, text)`` to one row per row: ``doc_id, n_shingles, component_id, kept``.

    Linked are documents with ``100 * |A and B| >= percent * |A or B|`` over full sets of ``width``-word
    shingles. At 0.85 a band of 5 rows of 100 bins misses a linked pair with probability 8e-6.
    """
    found = near_rows(docs, percent, width, bins, rows)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each component, the first; documents without shingles stay, each row of them."""
    doc, text_hash, n, size = unused(docs, "doc", "hash", "rows", "size")
    found = near_rows(docs.select("doc_id", "text"), percent, width, bins, rows).where("first")
    keep = found.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)).agg(F.count("*").alias(n), F.max("n_shingles").alias(size))
    here = docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(text_hash))
    kept = docs.join(keep, here)
    # Rows that repeat an id and a text are rare, but may be many: one of them stays.
    once = kept.where((F.col(n) > 1) & (F.col(size) > 0)).dropDuplicates([doc, text_hash])
    return kept.where((F.col(n) == 1) | (F.col(size) == 0)).unionByName(once).select(*[f"`{c}`" for c in docs.columns])
