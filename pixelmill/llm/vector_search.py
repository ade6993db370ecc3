"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Inner products become distances by one more coordinate: with R the largest norm, x goes to (x, sqrt(R^2 - |x|^2))
and a query to (q, 0), and the nearest in Euclidean distance is the largest inner product. Rows are dealt to
shards by hash, each of about ``SHARD_ROWS``; a shard's distinct vectors form a vantage-point tree. Queries visit
every shard in blocks. A branch is left out if the triangle inequality puts it beyond ``factor`` times the
distance of the k-th found so far; factor one restores exact search, smaller ones visit less.

Each visit answers a block's k best of that shard, and a grouped rank takes the k best of those. Equal vectors
are one point of the tree with their ids in order, so that a vector that many rows share is one distance. Scores
are inner products of the original vectors in double precision; ties go to the smaller id, in the tree, too: what may
tie with the k-th is compared by its exact score, and branches at the k-th's distance are visited.

Edge cases: vectors that are null, empty, zero, of another length than ``dim``, or hold null or non-finite
components take no part, and neither do rows with a null id; rows that repeat an id are candidates of their own;
with fewer than k candidates all are returned; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut

SHARD_ROWS, BLOCK_ROWS, TASK_BLOCKS, LEAF = 16384, 1024, 32, 256
FACTOR = 0.35
#: What rounding may add to a distance, as a part of the largest one.
SLACK = 1e-7


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``vec_id`` and ``embedding`` of the rows that take part, in double precision."""
    v = F.col("embedding")
    fine = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    out = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine)
    out = out.select("vec_id", v.cast("array<double>").alias("embedding"))
    return out if dim is None else out.where(F.size("embedding") == dim)


class Tree:
    """A vantage-point tree over points (rows of a matrix), searched by groups of queries at once."""

    def __init__(self, points: np.ndarray, seed: int = 0) -> None:
        self.points, self.rng = points, np.random.default_rng(seed)
        self.square = float((points * points).sum(1).max(initial=0))  # R^2, which all points have
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray) -> tuple:
        if len(at) <= LEAF:
            return (at,)
        few = self.rng.choice(at, 8, replace=False)
        probe = self.points[self.rng.choice(at, min(64, len(at)), replace=False)]
        spread = [np.var(_distances(self.points[[c]], probe)[0]) for c in few]  # a vantage point with much spread
        vantage = few[int(np.argmax(spread))]
        d = _distances(self.points[[vantage]], self.points[at])[0]
        mid = np.median(d)
        near = d <= mid
        if near.all():
            near = d < mid
            if not near.any():
                return (at,)
        inner, outer = d[near], d[~near]
        return vantage, (inner.min(), inner.max()), (outer.min(), outer.max()), self._build(at[near]), self._build(at[~near])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query (q, 0) the inner products and rows of its ``k`` best points found (all, if there are fewer), best
        first, and of equal ones the smaller row. With factor one they are the best of all."""
        n, k = len(queries), min(k, len(self.points))
        norm = (queries * queries).sum(1)
        found = _Found(queries[:, :-1], np.full((n, k), -np.inf), np.full((n, k), len(self.points)), norm, self.square + norm)
        self._visit(self.root, queries, np.arange(n), found, factor)
        return found.score, found.who

    def _visit(self, node: tuple, queries: np.ndarray, group: np.ndarray, found: _Found, factor: float) -> None:
        if not len(group):
            return
        if len(node) == 1:
            found.add(group, node[0], self.points[node[0], :-1])
            return
        vantage, inside, outside, near, far = node
        d = _distances(queries[group], self.points[[vantage]])[:, 0]
        first_near = d <= inside[1]
        for own, one, its, other, others in ((group[first_near], near, inside, far, outside), (group[~first_near], far, outside, near, inside)):
            if len(own):
                dist = d[first_near] if one is near else d[~first_near]
                for child, (low, high) in ((one, its), (other, others)):
                    beyond = np.maximum(np.maximum(low - dist, dist - high), 0)
                    reach, slack = found.reach(own)
                    self._visit(child, queries, own[beyond <= factor * reach + slack], found, factor)


@dataclass
class _Found:
    """The best points of each query so far, by exact inner product and then row."""

    q: np.ndarray
    score: np.ndarray
    who: np.ndarray
    norm: np.ndarray
    total: np.ndarray  # R^2 + |q|^2

    def reach(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance of the last one kept, and what rounding may add to distances: points at that very distance are to be met."""
        return np.sqrt(np.maximum(self.total[own] - 2 * self.score[own, -1], 0)), SLACK * np.sqrt(self.total[own])

    def add(self, group: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
        """Takes points into the lists of a group of queries. Matrix products tell which may get in; exact ones decide."""
        k, q = self.score.shape[1], self.q[group]
        about = q @ x.T
        least = self.score[group, -1]
        if len(rows) >= k:
            least = np.maximum(least, np.partition(about, len(rows) - k, axis=1)[:, len(rows) - k])
        error = 8 * x.shape[1] * np.finfo(float).eps * np.sqrt(self.norm[group] * (x * x).sum(1).max(initial=0))
        at, of = np.nonzero(about >= (least - error)[:, None])
        many = np.bincount(at, minlength=len(group))
        place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        score = np.full((len(group), k + int(many.max(initial=0))), -np.inf)
        who = np.full(score.shape, np.iinfo(np.int64).max)
        score[:, :k], who[:, :k] = self.score[group], self.who[group]
        score[at, k + place], who[at, k + place] = (x[of] * q[at]).sum(1), rows[of]
        best = np.lexsort((who, -score), axis=1)[:, :k]
        self.score[group], self.who[group] = np.take_along_axis(score, best, 1), np.take_along_axis(who, best, 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _answers(k: int, factor: float, radius: float):  # noqa: ANN202
    """One shard's answers to all its blocks of queries."""

    def run(key: tuple, shard: pa.Table, blocks: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not shard.num_rows or not blocks.num_rows:
            return empty
        ids, x = shard.column("vec_id").to_numpy(), _matrix(shard.column("embedding"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        points, group = np.unique(x, axis=0, return_inverse=True)
        by_group = np.argsort(group.reshape(-1), kind="stable")  # ids ascend within a group
        starts = np.searchsorted(group.reshape(-1)[by_group], np.arange(len(points) + 1))
        # Points by their smallest ids, so that of equal scores the smaller id's point is found.
        rank = np.argsort(ids[by_group[starts[:-1]]], kind="stable")
        points, first, last = points[rank], starts[:-1][rank], starts[1:][rank]
        tree = Tree(np.concatenate([points, np.sqrt(np.maximum(radius**2 - (points**2).sum(1), 0))[:, None]], 1))
        out_q, out_v, out_s = [], [], []
        for q_ids, q_flat in zip(blocks.column("ids").to_pylist(), blocks.column("vectors").to_pylist()):
            q_ids, q = np.array(q_ids), np.array(q_flat).reshape(len(q_ids), -1)
            scores, who = tree.search(np.concatenate([q, np.zeros((len(q), 1))], 1), k + 1, factor)  # one more, for itself
            for i in range(len(q)):
                at = who[i][np.isfinite(scores[i])]
                of = [by_group[first[p] : min(last[p], first[p] + k + 1)] for p in at]
                v = ids[np.concatenate(of)]
                s = np.repeat(scores[i][: len(at)], [len(o) for o in of])
                own = v != q_ids[i]
                v, s = v[own], s[own]
                best = np.lexsort((v, -s))[:k]
                out_q.append(np.full(len(best), q_ids[i]))
                out_v.append(v[best])
                out_s.append(s[best])
        if not out_q:
            return empty
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR) -> DataFrame:
    """``vectors(vec_id, embedding)`` to ``query_id, rank, vec_id, score``: the ``k`` best of each query, but itself."""
    scratch = Scratch(vectors.sparkSession)
    first = usable(vectors).select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = first["n"] if first else 0
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    rows = scratch.table(usable(vectors, dim).withColumn("norm", norm), "rows")
    n, radius = rows.agg(F.count("*"), F.max("norm")).first()
    shards = max(1, -(-n // SHARD_ROWS))
    # The stated queries, in blocks of bounded size, visit each shard; a task takes a bounded number of blocks.
    queries = rows.where(is_query)
    n_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    turns = F.explode(F.sequence(F.lit(0), F.lit((n_blocks - 1) // TASK_BLOCKS))).alias("turn")
    dealt = rows.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), turns)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")
    pairs = F.collect_list(F.struct("vec_id", "embedding"))
    blocks = queries.select("vec_id", "embedding", block).groupBy("block").agg(pairs.alias("q"))
    blocks = blocks.select(F.floor(F.col("block") / TASK_BLOCKS).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("q.vec_id").alias("ids"), F.flatten("q.embedding").alias("vectors"))
    found = dealt.groupBy("shard", "turn").cogroup(blocks.groupBy("shard", "turn")).applyInArrow(_answers(k, factor, float(radius or 0)), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    out = cut(ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    scratch.drop()
    return out
