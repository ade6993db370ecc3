"""Exact dedup of a new batch against an immutable snapshot, screened by static binary-fuse filters.

Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest doc_id stays.

1. Every text is normalised and digested (SHA-256) once.
2. Snapshot digests are grouped; each shard of them (by digest prefix, of bounded size) becomes a binary-fuse
   filter: three table slots and one byte of fingerprint for a digest (Graf and Lemire, 2022).
3. Digests of the new batch are grouped on their own - that finds duplicates inside the batch - and screened by
   their shard's filter. Negatives are sure to be new; positives join the exact digest buckets.
4. Within each bucket of more than one row, the normalised bytes themselves are compared with the keeper's.

``exact_duplicates`` takes both from one table and writes the snapshot for itself; ``save_snapshot`` keeps one in a
folder, and ``batch_duplicates`` holds any number of later batches against it with the filters that are there.

Groups are counted before any shuffle by digest, and joins back to rows are plain equi-joins that Spark splits
when a digest is hot, so a text that a third of all rows share is no single task.

Edge cases: null counts as empty; null doc_ids lose against any other (if all are null, keep_id is null and each
such row counts as kept); rows that repeat doc_id and text are one group whose rows with the largest doc_id all
count as kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.runtime import ship

from .common import Scratch, cut, mix

#: Digests of a shard on average.
SHARD_KEYS = 200_000


# ---- binary-fuse filter -------------------------------------------------------------------------


def _layout(n: int) -> tuple[int, int]:
    """Segment length and number of segments for ``n`` keys and three slots a key."""
    bits = int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25), 2, 18))
    length = 1 << bits
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, -(-int(n * factor) // length) - 2)


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of each hash, in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * length
    low = np.uint64(length - 1)
    return np.stack([first + (h & low).astype(np.int64), first + length + ((h >> np.uint64(18)) & low).astype(np.int64), first + 2 * length + (mix(h, 5) & low).astype(np.int64)])


def fuse_build(keys: np.ndarray) -> bytes:
    """A filter over distinct 64-bit keys, built by peeling in waves: all slots of one key at once, wave after wave."""
    n = len(keys)
    length, segments = _layout(n)
    size = (segments + 2) * length
    for seed in range(1, 200):
        h = mix(keys, seed)
        s = _slots(h, length, segments)
        alive, waves = np.ones(n, bool), []
        count = np.bincount(s.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the keys' numbers
        for k in range(3):
            np.bitwise_xor.at(owner, s[k], np.arange(n))
        while True:
            free = np.flatnonzero(count == 1)
            if not len(free):
                break
            who, at = np.unique(owner[free], return_index=True)
            slot = free[at]
            waves.append((who, slot))
            alive[who] = False
            for k in range(3):
                np.subtract.at(count, s[k][who], 1)
                np.bitwise_xor.at(owner, s[k][who], who)
        if not alive.any():
            break
        if seed % 8 == 0:
            segments += 1
            size = (segments + 2) * length
    else:
        raise ValueError("the keys are not distinct")
    table, finger = np.zeros(size, np.uint8), (mix(h, 9) & np.uint64(255)).astype(np.uint8)
    for who, slot in reversed(waves):
        # A wave's keys have a free slot each; other slots were settled by later waves or stay as they are.
        a, b, c = s[0][who], s[1][who], s[2][who]
        table[slot] = 0
        table[slot] = finger[who] ^ table[a] ^ table[b] ^ table[c]
    return np.array([seed, length, segments], "<u4").tobytes() + table.tobytes()


def fuse_contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """False for keys that are surely not in the filter; 1 in 256 of those is True all the same."""
    seed, length, segments = (int(v) for v in np.frombuffer(filter_, "<u4", 3))
    table = np.frombuffer(filter_, np.uint8, offset=12)
    h = mix(keys, seed)
    a, b, c = _slots(h, length, segments)
    return (mix(h, 9) & np.uint64(255)).astype(np.uint8) == table[a] ^ table[b] ^ table[c]


# ---- digests and filters ------------------------------------------------------------------------


def _digests(with_text: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes().lower() if t.is_valid else b"" for t in batch.column("text")]  # bytes.lower() is A-Z only
            sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            cols = [batch.column("doc_id"), batch.column("is_new"), sha, *([pa.array(texts, pa.binary())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "is_new", "sha", *(["body"] if with_text else [])])

    return run


def _key(column: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest as an integer."""
    return np.frombuffer(b"".join(v[:8] for v in column.to_pylist()), "<u8")


def _build(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([fuse_build(np.unique(_key(table.column("sha"))))], pa.binary())})


def _probe(key: tuple, fresh: pa.Table, filters: pa.Table) -> pa.Table:
    if not filters.num_rows or not fresh.num_rows:
        return fresh.slice(0, 0).select(["sha"])
    hit = fuse_contains(filters.column("filter")[0].as_py(), _key(fresh.column("sha")))
    return fresh.select(["sha"]).filter(pa.array(hit))


# ---- snapshots ----------------------------------------------------------------------------------


def _shard(shards: Column | int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("sha", 9, 6)), 16, 10).cast("long"), shards if isinstance(shards, Column) else F.lit(shards)).cast("int")


def _write_snapshot(groups: DataFrame, folder: str) -> None:
    """Writes ``groups(sha, keep_id, n)`` by shard, and a filter for each shard, below ``folder``."""
    spark = groups.sparkSession
    shards = max(1, -(-groups.count() // SHARD_KEYS))
    groups.withColumn("shard", _shard(shards)).write.parquet(f"{folder}/groups")
    kept = spark.read.parquet(f"{folder}/groups")
    filters = kept.select("shard", "sha").groupBy("shard").applyInArrow(_build, "shard int, filter binary")
    filters.withColumn("shards", F.lit(shards)).write.parquet(f"{folder}/filters")


def save_snapshot(docs: DataFrame, folder: str) -> None:
    """Writes the digests of ``docs(doc_id, text)`` and their filters to ``folder``, once for all batches to come.

    A snapshot does not change: a later one is written elsewhere, from its documents.
    """
    ship(docs.sparkSession)
    digests = docs.select("doc_id", F.lit(False).alias("is_new"), "text").mapInArrow(_digests(False), "doc_id long, is_new boolean, sha binary")
    _write_snapshot(digests.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").cast("long").alias("n")), folder)


def _met(fresh: DataFrame, folder: str) -> DataFrame:
    """Of ``fresh(sha)``, distinct digests of a batch, those of the snapshot, with ``k, m``, its group's keep_id and rows.

    Filters are read as they were saved. What they let through meets the exact buckets.
    """
    spark = fresh.sparkSession
    filters = spark.read.parquet(f"{folder}/filters")
    first = filters.select("shards").first()
    sharded = fresh.select("sha").withColumn("shard", _shard(first["shards"] if first else 1))
    positive = sharded.groupBy("shard").cogroup(filters.select("shard", "filter").groupBy("shard")).applyInArrow(_probe, "sha binary")
    groups = spark.read.parquet(f"{folder}/groups").select("sha", F.col("keep_id").alias("k"), F.col("n").alias("m"))
    return positive.join(groups, "sha")


def batch_duplicates(batch: DataFrame, folder: str) -> DataFrame:
    """``batch(doc_id, text)`` to ``doc_id, keep_id, group_size, kept, text_sha256`` within the batch and the snapshot in ``folder``.

    The batch is digested and grouped; nothing of the snapshot is built again, and of its groups only those are read
    whose digests its filters let through. ``kept`` tells that no row of the snapshot or the batch is to stay instead.
    """
    spark = batch.sparkSession
    scratch = Scratch(spark)
    rows = batch.select("doc_id", F.lit(True).alias("is_new"), "text").mapInArrow(_digests(False), "doc_id long, is_new boolean, sha binary")
    rows = scratch.table(rows, "digests")
    groups = scratch.table(rows.groupBy("sha").agg(F.max("doc_id").alias("own"), F.count("*").alias("n")), "groups")
    both = groups.join(_met(groups, folder), "sha", "left")
    decided = both.select("sha", F.greatest("own", "k").alias("keep_id"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("group_size"))
    out = rows.join(decided, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    out = cut(out)
    scratch.drop()
    return out


# ---- the operator -------------------------------------------------------------------------------


def exact_duplicates(docs: DataFrame, is_new: Column) -> DataFrame:
    """``docs(doc_id, text)`` to one row per row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``is_new`` tells the rows of the new batch from those of the snapshot; the result does not depend on it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", F.coalesce(is_new, F.lit(True)).alias("is_new"), "text")
    digests = scratch.table(docs.mapInArrow(_digests(False), "doc_id long, is_new boolean, sha binary"), "digests")

    groups = digests.groupBy("sha", "is_new").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = scratch.table(groups, "groups")
    old, fresh = groups.where("not is_new").drop("is_new"), groups.where("is_new").drop("is_new")
    snapshot = f"{scratch.root}/snapshot"
    _write_snapshot(old, snapshot)

    # Positives meet the exact buckets; what does not is new, and grouped with its own batch only.
    met = _met(fresh, snapshot)
    with_old = fresh.join(met, "sha", "left").select("sha", F.greatest("keep_id", "k").alias("keep_id"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("group_size"))
    only_old = old.join(met.select("sha"), "sha", "left_anti").select("sha", "keep_id", F.col("n").alias("group_size"))
    decided = scratch.table(with_old.unionByName(only_old), "decided")

    # Byte checks in buckets of more than one row.
    bodies = docs.mapInArrow(_digests(True), "doc_id long, is_new boolean, sha binary, body binary").select("doc_id", "sha", "body")
    shared = scratch.table(bodies.join(decided.where("group_size > 1"), "sha"), "shared")
    keepers = shared.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("sha", F.col("body").alias("kept_body")).dropDuplicates(["sha"])
    differ = shared.join(keepers, "sha").where("body <> kept_body").select("sha")
    if not differ.isEmpty():
        raise ValueError("texts that differ have one SHA-256 digest")

    out = digests.join(decided, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    out = cut(out)
    scratch.drop()
    return out
