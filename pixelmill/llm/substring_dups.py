"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts anywhere else go.

1. Every text is cut into anchored pieces (``anchors``), each the bytes of neighbouring windows with one anchor.
   Equal windows lie in pieces with one anchor hash, so what has to meet is spread over the whole cluster by it.
2. Anchors that stand in one place only are done: nothing of theirs repeats. If all pieces of an anchor have
   one content, all their windows repeat.
3. The distinct pieces of every other anchor form shards of whole anchors. A shard's suffix array is built by induced
   sorting (``suffixes``), and a window repeats if its suffix shares ``length`` bytes with a neighbour's, as the
   permuted common prefixes tell. Pieces that occur several times are sorted once and repeat as a whole.
4. An anchor with more than ``MOST_KINDS`` distinct pieces would make its shard unbounded. Its windows are spread
   anew by a hash of their whole content, and those that meet another repeat.
5. Ranges of repeated windows come together by document, and their bytes are removed.

Hashes are of 64 bits and compared only under an equal anchor hash.

Edge cases: null counts as empty; texts shorter than ``length`` stay whole; rows that repeat a doc_id and text
are copies of each other; a null doc_id stays null; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import pieces, window_hashes
from .common import Scratch, blocks, cut, text_bytes
from .screens import passes, screen
from .suffixes import permuted_common_prefixes, suffix_array

LENGTH = 200
#: Distinct pieces of one anchor that one shard takes.
MOST_KINDS = 20_000
#: Bytes of pieces that are sorted together; more only if one anchor has more.
SHARD_BYTES = 2_000_000


def _anchors(length: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for lo, hi in blocks(offs):
                for doc, start, count, anchor, content in pieces(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], length):
                    at = pa.array(doc + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                        names=["doc_id", "text_hash", "start", "n", "k1", "content"],
                    )

    return run


def _passing(bitmap: Broadcast):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bitmap.value, batch.column("k1").to_numpy())))

    return run


def _cut_pieces(length: int):  # noqa: ANN202
    """The bytes of the pieces listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            lists = batch.column("wanted")
            flat, per = lists.flatten(), np.diff(lists.offsets.to_numpy())
            k1, content, start, n = (flat.field(i).to_numpy() for i in range(4))
            at = np.repeat(offs[:-1], per) + start
            size = n.astype(np.int64) + length - 1
            ends = np.cumsum(size)
            raw = data[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(content), pa.array(n), body.cast(pa.binary())], names=["k1", "content", "n", "body"])

    return run


def repeated_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct strings, the starts of its windows that also start elsewhere in them."""
    size = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(size + 1)
    begins = ends - size - 1
    text = np.ones(int(ends[-1]) + 1, np.uint16)  # 0 ends the text, 1 a string
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    text[:-1] = raw.astype(np.uint16) + 2
    text[ends - 1] = 1
    text[-1] = 0
    order = suffix_array(text, 258)
    before, common = permuted_common_prefixes(text, order)
    stop = np.repeat(ends - 1, size + 1)  # where each position's string ends
    at = np.flatnonzero((common[:-1] >= length) & (np.arange(len(text) - 1) + length <= stop))
    hit = np.zeros(len(text), bool)
    hit[at] = True
    hit[before[at]] = True  # their first bytes are the same, so they are as far from their string's end
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begins, size)]


def _sort_shards(length: int):  # noqa: ANN202
    """Pieces in order of their anchors to the starts of their repeated windows, shard after shard."""

    def solve(keys: list[tuple[int, int]], bodies: list[bytes]) -> pa.RecordBatch:
        k1, content, starts, counts = [], [], [], []
        for key, f in zip(keys, repeated_windows(bodies, length)):
            if len(f):  # neighbouring windows are one run
                new = np.flatnonzero(np.diff(f, prepend=-2) > 1)
                n = np.diff(np.concatenate([new, [len(f)]]))
                k1 += [key[0]] * len(new)
                content += [key[1]] * len(new)
                starts += f[new].tolist()
                counts += n.tolist()
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(content, pa.int64()), pa.array(starts, pa.int32()), pa.array(counts, pa.int16())], names=["k1", "content", "at", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        bodies: list[bytes] = []
        held = 0
        for batch in batches:
            for k1, content, body in zip(batch.column("k1").to_pylist(), batch.column("content").to_pylist(), batch.column("body").to_pylist()):
                if keys and keys[-1] == (k1, content):
                    continue  # rows that repeat a document list its pieces again
                if held > SHARD_BYTES and k1 != keys[-1][0]:
                    yield solve(keys, bodies)
                    keys, bodies, held = [], [], 0
                keys.append((k1, content))
                bodies.append(body)
                held += len(body)
        if keys:
            yield solve(keys, bodies)

    return run


def _windows(length: int):  # noqa: ANN202
    """All windows of pieces of hot anchors, by a hash of their whole content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, content, body in zip(batch.column("k1").to_pylist(), batch.column("content").to_pylist(), batch.column("body").to_pylist()):
                h = window_hashes(np.frombuffer(body, np.uint8), length)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k1)), pa.array(np.full(n, content)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h.view(np.int64))], names=["k1", "content", "at", "window"])

    return run


def _outcome(length: int, with_text: bool):  # noqa: ANN202
    """Each text's removed runs and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            lists = batch.column("ranges")
            per = np.diff(lists.offsets.to_numpy())
            flat, at = lists.flatten(), 0
            starts, counts = (flat.field(i).to_numpy().astype(np.int64) for i in range(2))
            n_bytes, n_removed, n_spans = np.diff(offs), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            sha, spans, kept_all = [], [], []
            for i, n in enumerate(np.where(lists.is_valid().to_numpy(zero_copy_only=False), per, 0).tolist()):
                body = data[offs[i] : offs[i + 1]]
                runs: list[dict] = []
                if n:
                    # Runs in order, and those that touch as one.
                    a = starts[at : at + n]
                    order = np.argsort(a)
                    a, z = a[order], np.maximum.accumulate((a + counts[at : at + n] + length - 1)[order])
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
                    a, z = a[new], z[np.concatenate([new[1:], [n]]) - 1]
                    at += n
                    n_removed[i], n_spans[i] = (z - a).sum(), len(a)
                    runs = [{"start": x, "stop": y} for x, y in zip(a.tolist(), z.tolist())] if with_text else []
                    edges = [0, *np.stack([a, z], 1).reshape(-1).tolist(), len(body)]
                    body = np.concatenate([body[x:y] for x, y in zip(edges[::2], edges[1::2])])
                kept = body.tobytes()
                sha.append(hashlib.sha256(kept).hexdigest())
                spans.append(runs)
                kept_all.append(kept)
            cols = [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), pa.array(sha)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept_all, pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH, most_kinds: int = MOST_KINDS) -> DataFrame:
    """``docs(doc_id, text_hash, text)`` to ``doc_id, text_hash, ranges``: runs of repeated windows (start, number)."""
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, text_hash long, start int, n smallint, k1 long, content long"
    anchors = scratch.table(docs.mapInArrow(_anchors(length), schema), "anchors")
    met = anchors.groupBy("k1").agg(F.count("*").alias("places"), F.min("content").alias("a"), F.max("content").alias("b")).where("places > 1")
    met = scratch.table(met.select("k1", (F.col("a") == F.col("b")).alias("same")), "met")
    bitmap = sc.broadcast(screen(met.select("k1")))
    candidates = anchors.mapInArrow(_passing(bitmap), schema).join(met.hint("merge"), "k1")
    candidates = scratch.table(candidates, "candidates")
    scratch.drop("anchors")
    whole = candidates.where("same").select("doc_id", "text_hash", "start", "n")

    # Anchors with pieces of several contents.
    open_ = candidates.where("not same")
    place = F.struct("doc_id", "text_hash", "start", "n")
    kinds = open_.groupBy("k1", "content").agg(F.count("*").alias("places"), F.min(place).alias("at"))
    kinds = scratch.table(kinds, "kinds")
    hot = kinds.groupBy("k1").count().where(F.col("count") > most_kinds).select("k1")
    wanted = kinds.groupBy(F.col("at.doc_id").alias("_doc"), F.col("at.text_hash").alias("k1")).agg(F.collect_list(F.struct("k1", "content", "at.start", "at.n")).alias("wanted"))
    wanted = scratch.table(wanted, "wanted")
    in_texts = sc.broadcast(screen(wanted.select("k1")))
    texts = docs.select("doc_id", F.col("text_hash").alias("k1"), "text").mapInArrow(_passing(in_texts), "doc_id long, k1 long, text string").withColumnRenamed("k1", "text_hash")
    wanted = wanted.withColumnRenamed("k1", "_hash").hint("merge")
    listed = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    bodies = listed.select("text", "wanted").mapInArrow(_cut_pieces(length), "k1 long, content long, n smallint, body binary")
    has_hot = not hot.isEmpty()
    if has_hot:
        bodies = scratch.table(bodies, "bodies")
    spread = (bodies.join(hot, "k1", "left_anti") if has_hot else bodies).select("k1", "content", "body")
    shards = spread.repartition(_shards(kinds), "k1").sortWithinPartitions("k1", "content")
    marks = scratch.table(shards.mapInArrow(_sort_shards(length), "k1 long, content long, at int, windows smallint"), "marks")
    if has_hot:
        windows = scratch.table(bodies.join(hot, "k1", "left_semi").select("k1", "content", "body").dropDuplicates(["k1", "content"]).mapInArrow(_windows(length), "k1 long, content long, at int, window long"), "windows")
        twice = windows.groupBy("k1", "window").count().where("count > 1").select("k1", "window")
        marks = marks.unionByName(windows.join(twice, ["k1", "window"]).select("k1", "content", "at", F.lit(1).cast("smallint").alias("windows")))
    # Pieces that stand in several places repeat there as a whole; of the others, which have one place, parts do.
    several = open_.join(kinds.where("places > 1").select("k1", "content"), ["k1", "content"], "left_semi")
    whole = whole.unionByName(several.select("doc_id", "text_hash", "start", "n"))
    single = kinds.where("places = 1").join(marks.withColumnRenamed("at", "mark"), ["k1", "content"])
    single = single.select("at.doc_id", "at.text_hash", (F.col("at.start") + F.col("mark")).cast("int").alias("start"), F.col("windows").alias("n"))
    ranges = whole.unionByName(single).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))  # bounded by the text
    ranges = scratch.table(ranges, "ranges")
    scratch.drop_all_but("ranges")
    return ranges


def _shards(kinds: DataFrame) -> int:
    """Enough tasks for shards of a few batches each."""
    spark = kinds.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), kinds.count() * 300 // (8 * SHARD_BYTES) + 1)


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, most_kinds: int = MOST_KINDS) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``spans, kept``."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = repeated_ranges(docs, scratch, length, most_kinds).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    joined = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    more = ", spans array<struct<start:long,stop:long>>, kept binary" * with_text
    out = joined.select("doc_id", "text", "ranges").mapInArrow(_outcome(length, with_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
    if with_text:
        return out
    out = cut(out)
    scratch.drop()
    return out
