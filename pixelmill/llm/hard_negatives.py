"""Hard negatives by a pivot table: rows of another label that score almost as high as an anchor's positives.

Scores are inner products of whole numbers, ``floor(SCALE * c)`` of each component c. With R the largest norm, a row x
goes to (x, sqrt(R^2 - |x|^2)) and an anchor q to (q, 0), and then ``d(q, x)^2 = R^2 + |q|^2 - 2 * score``: a larger
score is a smaller distance. Distances to ``PIVOTS`` pivots, stored with each row, bracket it:
``max |d(q, p) - d(x, p)| <= d(q, x) <= min d(q, p) + d(x, p)``.

1. Pivots lie far apart among ``SAMPLE`` rows with the smallest hashes. Rows are dealt by their nearest pivot, by rings
   of distance to it and, where a ring has more, by hash into cells of about ``CELL_ROWS``, each known by its least and
   largest distance to each pivot.
2. An anchor's positives: the sample gives a score that its last positive has at least. Anchors are routed to the cells
   whose bracket reaches it, there skip the rows whose own bracket does not, and take exact scores of the others.
3. A positive's negatives: the same with the window of scores that they may have, cut short by the sample where that
   holds enough of them.

Brackets only save work: what they leave is checked exactly, and what they rule out cannot be in the result, whatever
the sample. Anchors (the stated queries) meet cells in tiles of bounded size; no task holds more than a tile of anchors
and a cell of rows.

Edge cases: rows with a null id, label or vector, with null or non-finite components, with an empty vector or one of
another length than most (the longer of two lengths met equally often), or so large that a score could overflow a long
(components of some 2**31 / SCALE / sqrt(length)) take no part. Rows that repeat an id are candidates of their own, but
not for an anchor of their id; of several rows with an anchor's id the least (label, vector) is the anchor. Equal scores
go by smaller id. An anchor without positives, or a positive with an empty window, as below a score of zero, has no
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut

SCALE = 256
#: Rows that pivots are chosen from and first thresholds come from, and the number of pivots.
SAMPLE, PIVOTS = 2048, 16
#: Rows of a cell, rings of a pivot at most, anchors and cells of a tile.
CELL_ROWS, RINGS, TILE_ANCHORS, TILE_CELLS = 8192, 8, 4096, 4096
#: What rounding may add to a distance, as a part of R.
SLACK = 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part."""
    v = F.col("embedding")
    most = F.sqrt(F.lit(2.0**62) / F.size(v)) - 1
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) * float(SCALE) < most, F.lit(False)))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v).where(there).where(fine)
    rows = rows.select("vec_id", "label", x.alias("x"))
    first = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("x") == (first["dim"] if first else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows x with q, as longs: by doubles where they hold every sum, else by longs."""
    if len(x) and int(np.abs(x).max()) * int(np.abs(q).max(initial=0)) * x.shape[1] < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    return x @ q.T


class Pivots:
    """The pivots and the space they are in."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, square: int) -> None:
        self.ids, self.labels, self.x, self.square = ids, labels, x, float(square)  # the sample, and R^2
        first = self._between(x, x[:1])[:, 0]
        chosen = [int(np.argmax(first))]
        near = self._between(x, x[chosen])[:, 0]
        while len(chosen) < min(PIVOTS, len(x)) and near.max() > 0:
            chosen.append(int(np.argmax(near)))
            near = np.minimum(near, self._between(x, x[chosen[-1:]])[:, 0])
        self.points = x[chosen]

    def _height(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = (x.astype(np.float64) ** 2).sum(1)
        return norm, np.sqrt(np.maximum(self.square - norm, 0))

    def _between(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        (a, ha), (b, hb) = self._height(x), self._height(p)
        d = a[:, None] + b[None, :] - 2 * (x.astype(np.float64) @ p.astype(np.float64).T) + (ha[:, None] - hb[None, :]) ** 2
        return np.sqrt(np.maximum(d, 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        return self._between(x, self.points)

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors to the pivots."""
        norm = (q.astype(np.float64) ** 2).sum(1)
        return np.sqrt(np.maximum(self.square + norm[:, None] - 2 * (q.astype(np.float64) @ self.points.astype(np.float64).T), 0))

    def bounds(self, anchor: np.ndarray, norm: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score that an anchor can have with rows whose distances to the pivots are in ``low`` to ``high``."""
        slack = SLACK * np.sqrt(self.square) + 1e-9
        near = np.maximum(np.maximum(low - anchor, anchor - high).max(1) - slack, 0)
        far = (anchor + high).min(1) + slack
        total = self.square + norm
        return (total - far * far) / 2, (total - near * near) / 2


# ---- tables -------------------------------------------------------------------------------------


def _described(pivots: Pivots, rings: int):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x = _matrix(b.column("x"))
            d = pivots.of_rows(x)
            home = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            ring = np.minimum(d.min(1) * rings / max(2 * np.sqrt(pivots.square), 1e-9), rings - 1) if len(d) else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array((home * rings + ring.astype(np.int64)).astype(np.int32))], names=[*b.schema.names, "d", "ring"])

    return run


_TABLE = "vec_id long, label long, x array<bigint>, d array<double>, ring int"


def pivot_table(rows: DataFrame, pivots: Pivots, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows with their distances ``d`` and ``cell``, and a row for each cell with ``low, high`` of its distances."""
    rings = max(1, min(RINGS, n // (PIVOTS * CELL_ROWS)))
    table = scratch.table(rows.mapInArrow(_described(pivots, rings), _TABLE), "described")
    counts = {r["ring"]: r["count"] for r in table.groupBy("ring").count().collect()}  # PIVOTS * RINGS rows at most
    splits = F.create_map(*[F.lit(v) for ring, count in sorted(counts.items()) for v in (ring, -(-count // CELL_ROWS))])
    cell = F.col("ring").cast("long") * (1 << 40) + F.pmod(F.xxhash64("vec_id", "x"), splits[F.col("ring")])
    table = table.withColumn("cell", cell).drop("ring")
    k = len(pivots.points)
    ends = [f(F.col("d")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(k)]
    cells = table.groupBy("cell").agg(*ends)
    cells = cells.select("cell", F.array(*[f"low{i}" for i in range(k)]).alias("low"), F.array(*[f"high{i}" for i in range(k)]).alias("high"))
    return table, scratch.table(cells, "cells")


def _first_windows(pivots: Pivots, count: int):  # noqa: ANN202
    """Anchors with their distances, and the one window of scores that positives can have as the sample shows it."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            q, ids, labels = _matrix(b.column("x")), b.column("anchor_id").to_numpy(), b.column("label").to_numpy()
            d = pivots.of_anchors(q)
            s = scores(pivots.x, q)
            low = []
            for i in range(len(ids)):
                own = np.sort(s[(pivots.labels == labels[i]) & (pivots.ids != ids[i]), i])
                low.append([int(own[-count]) if len(own) >= count else -(2**62)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.reshape(-1)))
            cols = [*b.columns, lists, pa.array(low, pa.list_(pa.int64())), pa.array([[2**62]] * len(ids), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "d", "low", "high"])

    return run


def _next_windows(pivots: Pivots, count: int, percent: int):  # noqa: ANN202
    """Anchors with the windows of scores of their positives' negatives; ``high`` are the positives' scores."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            q, ids, labels = _matrix(b.column("x")), b.column("anchor_id").to_numpy(), b.column("label").to_numpy()
            s = scores(pivots.x, q)
            lows = []
            for i, highs in enumerate(b.column("high").to_pylist()):
                other = np.sort(s[(pivots.labels != labels[i]) & (pivots.ids != ids[i]), i])
                low = [-(-h * percent // 100) for h in highs]
                for w, h in enumerate(highs):
                    upto = np.searchsorted(other, h, "right")
                    if upto >= count:
                        low[w] = max(low[w], int(other[upto - count]))
                lows.append(low)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lows, pa.list_(pa.int64()))], names=[*b.schema.names, "low"])

    return run


# ---- search -------------------------------------------------------------------------------------


def _norm(q: np.ndarray) -> float:
    return float((q.astype(np.float64) ** 2).sum())


def _reach(low: list[int], high: list[int]) -> tuple[int, int] | None:
    """The least window that holds all that are not empty."""
    some = [(a, b) for a, b in zip(low, high) if a <= b]
    return (min(a for a, _ in some), max(b for _, b in some)) if some else None


def _routes(pivots: Pivots):  # noqa: ANN202
    """A tile's anchors and cells to the pairs whose bracket meets one of the anchor's windows."""

    def run(key: tuple, cells: pa.Table, anchors: pa.Table) -> pa.Table:
        found_a, found_c = [], []
        if cells.num_rows and anchors.num_rows:
            who, low, high = cells.column("cell").to_numpy(), _matrix(cells.column("low")), _matrix(cells.column("high"))
            q, d, ids = _matrix(anchors.column("x")), _matrix(anchors.column("d")), anchors.column("anchor_id").to_numpy()
            for i, window in enumerate(map(_reach, anchors.column("low").to_pylist(), anchors.column("high").to_pylist())):
                if window:
                    least, most = pivots.bounds(d[i], _norm(q[i]), low, high)
                    hit = who[(most >= window[0]) & (least <= window[1])]
                    found_a.append(np.full(len(hit), ids[i]))
                    found_c.append(hit)
        empty = [np.zeros(0, np.int64)]
        return pa.table({"anchor_id": np.concatenate(found_a or empty), "cell": np.concatenate(found_c or empty)})

    return run


def _visits(pivots: Pivots, count: int, same_label: bool):  # noqa: ANN202
    """A cell's rows and the anchors routed there to the ``count`` first rows of each anchor and window."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if rows.num_rows and anchors.num_rows:
            ids, labels, x, d = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("x")), _matrix(rows.column("d"))
            order = np.lexsort((ids, labels))
            ids, labels, x, d = ids[order], labels[order], x[order], d[order]
            q, qd = _matrix(anchors.column("x")), _matrix(anchors.column("d"))
            a_ids, a_labels = anchors.column("anchor_id").to_numpy(), anchors.column("label").to_numpy()
            lows, highs = anchors.column("low").to_pylist(), anchors.column("high").to_pylist()
            for i, own in enumerate(a_ids.tolist()):
                least, most = pivots.bounds(qd[i], _norm(q[i]), d, d)
                window = _reach(lows[i], highs[i])
                if window is None:
                    continue
                a, b = np.searchsorted(labels, a_labels[i], "left"), np.searchsorted(labels, a_labels[i], "right")
                may = np.full(len(ids), not same_label)
                may[a:b] = same_label
                at = np.flatnonzero(may & (ids != own) & (most >= window[0]) & (least <= window[1]))
                s = scores(x[at], q[i])
                rank = np.lexsort((ids[at], -s))
                at, s = at[rank], s[rank]
                for w, (low, high) in enumerate(zip(lows[i], highs[i])):
                    first = int(np.searchsorted(-s, -high, "left"))
                    last = min(first + count, int(np.searchsorted(-s, -low, "right")))
                    if last > first:
                        out[0].append(np.full(last - first, own))
                        out[1].append(np.full(last - first, w))
                        out[2].append(ids[at[first:last]])
                        out[3].append(s[first:last])
        cols = [np.concatenate(c or [np.zeros(0, np.int64)]) for c in out]
        return pa.table(dict(zip(("anchor_id", "window", "vec_id", "score"), cols)))

    return run


def _search(anchors: DataFrame, n_anchors: int, table: DataFrame, cells: DataFrame, n_cells: int, pivots: Pivots, count: int, same_label: bool, scratch: Scratch, name: str) -> DataFrame:
    """``anchors(anchor_id, label, x, d, low, high)`` to ``anchor_id, window, vec_id, score, rank``, ``count`` at most of each window."""
    turns, chunks = max(1, -(-n_anchors // TILE_ANCHORS)), max(1, -(-n_cells // TILE_CELLS))
    anchors = scratch.table(anchors.withColumn("turn", F.pmod(F.xxhash64("anchor_id"), F.lit(turns)).cast("int")), f"{name}_anchors")
    spread = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    tiles = cells.withColumn("chunk", F.pmod(F.xxhash64("cell"), F.lit(chunks)).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    routes = tiles.groupBy("chunk", "turn").cogroup(spread.groupBy("chunk", "turn")).applyInArrow(_routes(pivots), "anchor_id long, cell long")
    routed = scratch.table(routes.join(anchors.select("anchor_id", "turn"), "anchor_id"), f"{name}_routes")
    rows = table.join(routed.select("cell", "turn").distinct(), "cell")
    visitors = routed.select("anchor_id", "cell").join(anchors, "anchor_id")
    found = rows.groupBy("cell", "turn").cogroup(visitors.groupBy("cell", "turn")).applyInArrow(_visits(pivots, count, same_label), "anchor_id long, window long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")))
    return scratch.table(ranked.where(F.col("rank") <= count), name)


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label the first ``negatives`` rows of another
    label that score at least ``percent`` percent of the positive, and not more than it. ``is_anchor`` reads ``vec_id``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(usable(vectors), "rows")
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c)
    n, square = rows.agg(F.count("*"), F.max(norm)).first()
    if not n:
        scratch.drop()
        return spark.createDataFrame([], _OUT)
    sample = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id", "label", "x").limit(SAMPLE).toArrow()
    pivots = Pivots(sample.column("vec_id").to_numpy(), sample.column("label").to_numpy(), _matrix(sample.column("x")), square)
    table, cells = pivot_table(rows, pivots, n, scratch)
    n_cells = cells.count()

    one = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("at"))
    anchors = one.select(F.col("vec_id").alias("anchor_id"), "at.label", "at.x")
    schema = "anchor_id long, label long, x array<bigint>, d array<double>, low array<bigint>, high array<bigint>"
    anchors = scratch.table(anchors.mapInArrow(_first_windows(pivots, positives), schema), "anchors")
    n_anchors = anchors.count()
    found = _search(anchors, n_anchors, table, cells, n_cells, pivots, positives, True, scratch, "positives")

    # A window for each positive, best first.
    windows = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).getField("score").alias("high"))
    again = anchors.drop("low", "high").join(windows, "anchor_id").select("anchor_id", "label", "x", "d", "high")
    again = again.mapInArrow(_next_windows(pivots, negatives, percent), schema.replace("low array<bigint>, high array<bigint>", "high array<bigint>, low array<bigint>"))
    negative = _search(again, n_anchors, table, cells, n_cells, pivots, negatives, False, scratch, "negatives")
    pairs = negative.join(found.select("anchor_id", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "window"])
    out = cut(pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    scratch.drop()
    return out
