"""Fuzzy line dedup: character shingles, sketches, banding, exact verification and connected components.

A line is what stands between line feeds. It is compared with A-Z lower-cased and runs of white space made one
blank; empty lines then take no part and stay. A line's set is its distinct runs of ``WIDTH`` characters, of a shorter
line the whole of it. Linked are those with
``100 * |A and B| >= percent * |A or B|``; of each component the line that comes first by (doc_id, number) stays,
in the document where it stands, and all others go. Candidates share one of 22 bands of 4 sketch bins, which misses
a pair at 0.8 with probability 9e-6 and at 0.85 with 1e-7; ``set_links`` verifies and connects them.

All texts are split and sketched once, in blocks of lines; only the lines that share a band are read again, by their
place. Memory is bounded by an Arrow batch and some 60 times a block, which is a quarter of a megabyte or one longer line.

Edge cases: a null text stays null and an empty one empty, without lines to drop; a document may lose all lines,
and stays with an empty text; rows with one doc_id count their lines together in the order of their texts; of rows
that repeat doc_id and text, all keep or lose the same lines; a null doc_id comes last; other columns are kept,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, by_place, cut, distinct, mix, text_bytes, unused
from .line_kernel import BLOCK, Lines, line_blocks
from .near_dups import band_lists, sketch
from .set_links import SIGNS, SIGNS_SCHEMA, set_components, signs

WIDTH, BINS, ROWS = 6, 88, 4
FEW = 11  # shingles of a line known by its digest
_BLANKS = re.compile(r"\s+")
_AZ = {c: c + 32 for c in range(0x41, 0x5B)}


def normal_lines(text: str) -> list[str]:
    """What ``line_kernel`` makes of a text, line by line."""
    return [_BLANKS.sub(" ", line).strip() for line in text.translate(_AZ).split("\n")]


def line_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct shingle hashes of each line of a column of normalised lines."""
    data, offs = text_bytes(column)
    for lo, hi in blocks(offs, BLOCK):
        cuts = offs[lo : hi + 1]
        lines = Lines(np.arange(len(cuts) - 1), np.zeros(len(cuts) - 1, np.int64), data[cuts[0] : cuts[-1]], cuts - cuts[0])
        hashes, cuts = distinct(*lines.shingles(width))
        for i in range(len(cuts) - 1):
            yield lo + i, hashes[cuts[i] : cuts[i + 1]]


_UNITS = "doc_id long, text_hash long, line int, k1 long, k2 long, bands binary, " + SIGNS_SCHEMA


def _digest(line: np.ndarray) -> bytes:
    return hashlib.blake2b(line.tobytes(), digest_size=16).digest()


def _once(hashes: np.ndarray, lines: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each of ``n`` lines, sorted, without the last bits that the line's number takes, and their offsets."""
    bits = np.uint64(n.bit_length())
    own = hashes >> bits
    own |= lines.view(np.uint64) << (np.uint64(64) - bits)
    own.sort()
    own = own[np.append(True, own[1:] != own[:-1])[: len(own)]]
    return own << bits, np.searchsorted(own, np.arange(n + 1, dtype=np.uint64) << (np.uint64(64) - bits))


def _units(width: int):  # noqa: ANN202
    """All lines with their key and, once a block for equal lines, bands and bitmap.

    The key of a line is a hash of its shingles with repeats or, where these are few, a digest of the line: lines of one
    key have one set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for lines in line_blocks(data, offs):
                hashes, cuts = lines.shingles(width)
                size = np.diff(cuts)
                k1 = mix(np.add.reduceat(hashes, cuts[:-1])).view(np.int64)
                again = hashes >> np.uint64(29)
                again ^= hashes
                again *= np.uint64(0x9E3779B97F4A7C15)
                k2 = mix(np.add.reduceat(again, cuts[:-1])).view(np.int64)
                short = np.flatnonzero(size < FEW)
                if len(short):
                    digests = b"".join(_digest(lines.data[lines.cuts[i] : lines.cuts[i + 1]]) for i in short.tolist())
                    k1[short], k2[short] = np.frombuffer(digests, np.int64).reshape(-1, 2).T
                fresh = np.zeros(len(k1), bool)
                fresh[np.unique(k1, return_index=True)[1]] = True
                number = np.cumsum(fresh) - 1
                take = np.repeat(fresh, size)
                sk = np.zeros((len(k1), BINS), np.uint64)
                own, line, n = hashes[take], np.repeat(number, size)[take], int(fresh.sum())
                sk[fresh] = sketch(own, line, n, BINS)
                at = pa.array(number, mask=~fresh)
                bits = [x.take(at) for x in signs(*_once(own, line, n))]
                who = pa.array(lines.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(who), batch.column("text_hash").take(who), pa.array(lines.numbers.astype(np.int32)), pa.array(k1), pa.array(k2), band_lists(sk, ROWS, fresh), *bits],
                    names=["doc_id", "text_hash", "line", "k1", "k2", "bands", *SIGNS],
                )

    return run


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of texts that ``wanted`` lists as (number, node), normalised."""

    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        lists = batch.column("wanted")
        rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        line, node = (lists.flatten().field(i).to_numpy() for i in range(2))
        order = np.lexsort((line, rows))
        line, node = line[order], node[order]
        places = (rows[order] << 32) + line
        for lines in line_blocks(data, offs):
            own = (lines.rows << 32) + lines.numbers
            at = np.minimum(np.searchsorted(places, own), len(places) - 1)
            hit = np.flatnonzero(places[at] == own)
            cuts = lines.cuts.astype(np.int64)
            texts = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(cuts), pa.py_buffer(lines.data)).take(pa.array(hit)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(node[at[hit]]), texts], names=["c", "text"])


def _without(text: str, gone: str, n: str):  # noqa: ANN202
    """Texts without the lines whose numbers are in ``gone``, and their number as ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, column = batch.column(gone), batch.column(text)
            counts = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
            new: list[str | None] = [None] * batch.num_rows
            for i in np.flatnonzero(counts.to_numpy()).tolist():
                drop = set(lists[i].as_py())
                new[i] = "\n".join(line for k, line in enumerate(column[i].as_py().split("\n")) if k not in drop)
            changed = pa.array(new, column.type)
            rest = [c for c in batch.schema.names if c not in (text, gone)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pc.coalesce(changed, column), counts], names=[*rest, text, n])

    return run


def dropped_lines(docs: DataFrame, scratch: Scratch, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, text_hash, gone``: the numbers of the lines that go, by document."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketched = scratch.table(docs.where("text <> ''").mapInArrow(_units(width), _UNITS), "sketched", dictionary=False)
    units = scratch.table(sketched.drop("bands", *SIGNS), "units")

    # Lines of one key; a node is known by the first word of its key, as classes of documents are in ``near_dups``.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line")

    def node_keys(rows: DataFrame, nodes: DataFrame) -> DataFrame:
        own = rows.join(nodes.withColumnRenamed("c", "k1"), "k1", "left_semi")
        return own.groupBy("k1").agg(F.min(F.struct("k2", place.alias("first"))).alias("at")).select("k1", "at.*")

    def describe(wanted: DataFrame) -> DataFrame:
        places = node_keys(units, wanted).groupBy("first.doc_id", "first.text_hash").agg(F.collect_list(F.struct("first.line", "k1")).alias("wanted"))
        return by_place(docs, places, ["text"], ["wanted"]).mapInArrow(_wanted_lines, "c long, text string")

    nodes = sketched.where("size is not null").select(F.col("k1").alias("c"), "bands", *SIGNS)
    comp = set_components(nodes, describe, partial(line_sets, width=width), percent, BINS // ROWS, scratch, "sketched")

    # Lines whose key has more than one or is linked are the only ones that can go.
    again = units.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select("k1")
    some = scratch.table(units.join(again.union(comp.select("node")).distinct(), "k1", "left_semi"), "some")

    # The first line of each key, then of each component.
    keys = scratch.table(some.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "keys")
    comp = keys.join(comp, F.col("k1") == F.col("node")).groupBy("k1").agg(F.min("k2").alias("k2"), F.min("comp").alias("comp"))
    keyed = scratch.table(keys.join(comp, ["k1", "k2"], "left").where("n > 1 or comp is not null"), "keyed")
    stays = keyed.where("comp is not null").groupBy("comp").agg(F.min("first").alias("stays"))
    keyed = keyed.join(stays, "comp", "left").select("k1", "k2", F.coalesce("stays", "first").alias("stays"))
    gone = some.select("k1", "k2", "doc_id", "text_hash", "line").join(keyed, ["k1", "k2"]).where(~place.eqNullSafe(F.col("stays")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("gone"))  # no more than a document's lines


def dedup_lines(docs: DataFrame, percent: int = 80, count: str = "n_dropped") -> DataFrame:
    """``docs`` with near-duplicate lines dropped from ``text``, and their number as a column ``count`` that ``docs`` lacks.

    The result reads a small table of dropped lines in the shared folder.
    """
    scratch = Scratch(docs.sparkSession)
    doc, text_hash, lines = unused(docs, "doc", "hash", "gone")
    gone = cut(dropped_lines(docs.select("doc_id", "text"), scratch, percent))
    scratch.drop()
    gone = gone.withColumnsRenamed({"doc_id": doc, "text_hash": text_hash, "gone": lines})
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left").drop(doc, text_hash)
    rest = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    out = joined.select(*[f"`{f.name}`" for f in rest], "text", lines).mapInArrow(_without("text", lines, count), f"{schema}, text string, `{count}` long")
    return out.select(*[f"`{c}`" for c in docs.columns], count)
