"""Embedding whitening from an exact covariance, by digit-slice matrix products.

Each entry c of a vector becomes the long ``x = floor(SCALE * c) + SHIFT``. The fit list holds each distinct x once: n
vectors with sums S. Centred are the integers ``y = n * x - S``, which are exact:

1. A task splits a block of y into limbs of ``LIMB`` bits. A product of two limb matrices adds at most ``BLOCK`` products
   of under 2**40, so that float64 BLAS gives it exactly.
2. Limb products are recombined as big integers: a task's part of ``sum of y y'``, one row of it a record.
3. Records are added up by row of the matrix, in two levels, and the covariance of x is that sum over n**3, each entry
   rounded to a double once.
4. The driver takes its eigenvectors. It holds (dimension)**2 numbers, however many vectors there are.

Projections use ``y / n``, which is ``x - S / n`` but for the last rounding, whatever the size of the mean.

Edge cases: vectors that are null, empty, of another length than most (the longer of two lengths met equally often),
hold null or non-finite entries, or an entry of 2**52 or more in magnitude are dropped; rows that repeat an id or are
repeated as a whole are rows of their own; a null vec_id stays null; components whose eigenvalue is zero to double
precision have no unit variance to give and are left out, so that a list of one distinct vector, or an empty table,
gives an empty result; a deviation that no long holds is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Bits of a limb, and rows of a block: 2 * LIMB bits and 13 for the sum stay within the 53 of a double.
LIMB, BLOCK = 20, 8192
#: Blocks after which limb sums, then below 2**63, are recombined.
FOLD = 64
#: Bytes of a big integer in a record, and first-level groups of a row's records.
WIDTH, SALTS = 48, 32
#: Entries beyond take no part: 64 times them is far inside a long.
LARGEST = float(2**52)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    v = F.col("embedding")
    fine = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))), F.lit(False))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long") + F.lit(SHIFT).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(fine & (F.size(v) > 0)).select("vec_id", x.alias("x"))
    first = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("x") == (first["dim"] if first else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Centre:
    """``y = n * x - S`` of rows x, in 64 bits where they suffice and in Python integers where they do not."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)  # S = n * whole + rest
        self.rest = np.array([s % n for s in sums], object)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """y and a bound of its magnitude."""
        d = x - self.whole
        bound = int(np.abs(d).max(initial=0)) * self.n + self.n
        if bound < 2**62:
            return d * np.int64(self.n) - self.rest.astype(np.int64), bound
        return d.astype(object) * self.n - self.rest, bound


def limbs(y: np.ndarray, bound: int) -> list[np.ndarray]:
    """Matrices D of small integers, lowest first, with ``y = sum of D[k] * 2**(LIMB * k)``; the last one is signed."""
    count = max(1, -(-(bound.bit_length() + 1) // LIMB))
    low = [((y >> (LIMB * k)) & (2**LIMB - 1)).astype(np.float64) for k in range(count - 1)]
    return [*low, (y >> (LIMB * (count - 1))).astype(np.float64)]


class Gram:
    """The exact sum of ``y y'`` over blocks of rows."""

    def __init__(self, dim: int) -> None:
        self.total = np.zeros((dim, dim), object)
        self.parts: dict[int, np.ndarray] = {}
        self.blocks = 0

    def add(self, y: np.ndarray, bound: int) -> None:
        for at in range(0, len(y), BLOCK):
            slices = limbs(y[at : at + BLOCK], bound)
            for j, a in enumerate(slices):
                for k in range(j, len(slices)):
                    product = (a.T @ slices[k]).astype(np.int64)
                    if k > j:
                        product = product + product.T
                    self.parts[j + k] = self.parts[j + k] + product if j + k in self.parts else product
            self.blocks += 1
            if self.blocks % FOLD == 0:
                self.fold()

    def fold(self) -> np.ndarray:
        for place, part in self.parts.items():
            self.total = self.total + part.astype(object) * (1 << LIMB * place)
        self.parts = {}
        return self.total


def _packed(row: np.ndarray) -> bytes:
    return b"".join(int(v).to_bytes(WIDTH, "little", signed=True) for v in row)


def _unpacked(cells: bytes) -> np.ndarray:
    return np.array([int.from_bytes(cells[i : i + WIDTH], "little", signed=True) for i in range(0, len(cells), WIDTH)], object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of rows as dimension -1, and its sums by dimension."""
    n, total = 0, None
    for batch in batches:
        x = _matrix(batch.column("x"))
        safe = len(x) == 0 or int(np.abs(x).max()) * len(x) < 2**62
        part = x.sum(0).astype(object) if safe else x.astype(object).sum(0)
        n, total = n + len(x), part if total is None else total + part
    if n:
        values = pa.array([Decimal(n), *(Decimal(int(v)) for v in total)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), values], names=["dim", "total"])


def _gram(centre: Centre):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = Gram(len(centre.whole))
        for batch in batches:
            if batch.num_rows:
                gram.add(*centre(_matrix(batch.column("x"))))
        if gram.blocks:
            total = gram.fold()
            salt = int(np.random.default_rng(abs(int(total[0, 0])) % 2**63).integers(SALTS))
            names = ["i", "salt", "cells"]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), salt, np.int32)), pa.array([_packed(r) for r in total], pa.binary())], names=names)

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total: np.ndarray | int = 0
    for cells in table.column("cells"):
        total = total + _unpacked(cells.as_py())
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([_packed(total)], pa.binary())})


def covariance(fit: DataFrame) -> tuple[Centre | None, np.ndarray]:
    """``fit(x)`` to what centres its rows and their covariance, each entry exact but for its rounding to a double."""
    sums = {r["dim"]: int(r["total"]) for r in fit.mapInArrow(_sums, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    n = sums.pop(-1, 0)
    if not n:
        return None, np.zeros((0, 0))
    centre = Centre(n, [sums[i] for i in range(len(sums))])
    parts = fit.mapInArrow(_gram(centre), "i int, salt int, cells binary")
    for keys in (["i", "salt"], ["i"]):
        parts = parts.groupBy(*keys).applyInArrow(_added, "i int, cells binary")
    rows = {r["i"]: _unpacked(r["cells"]) for r in parts.collect()}  # as many rows and columns as dimensions
    return centre, np.array([[v / n**3 for v in rows[i]] for i in range(len(rows))])


class Whitener:
    """The projection of rows x on the leading components, each to variance one."""

    def __init__(self, centre: Centre, cov: np.ndarray, most: int) -> None:
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1], axes[:, ::-1]
        total = float(np.trace(cov))
        k = min(most, int((values > total * len(cov) * 2.0**-50).sum()))
        self.centre, self.axes, self.values = centre, axes[:, :k], values[:k]
        self.explained = values[:k] / total if k else values[:0]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened values of the rows, and the exact sums of their squares of y."""
        y, bound = self.centre(x)
        safe = bound * bound * max(1, x.shape[1]) < 2**63
        squares = ((y * y) if safe else (y.astype(object) ** 2)).sum(1).tolist()
        white = (y.astype(np.float64) / self.centre.n) @ self.axes / np.sqrt(self.values)
        return white, [v if v < 2**63 else None for v in squares]


def _moments(whitener: Whitener):  # noqa: ANN202
    """A task's sums of whitened values and of their products, as (cell, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(whitener.values)
        total = np.zeros((k + 1, k))
        for batch in batches:
            white, _ = whitener(_matrix(batch.column("x")))
            total[:k] += white.T @ white
            total[k] += white.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["cell", "value"])

    return run


def identity_error(fit: DataFrame, whitener: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(whitener.values)
    cells = fit.mapInArrow(_moments(whitener), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # (k + 1) * k rows
    total = np.zeros((k + 1) * k)
    for r in cells:
        total[r["cell"]] = r["value"]
    total = total.reshape(k + 1, k) / whitener.centre.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _projected(whitener: Whitener, error: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(whitener.values)
        for batch in batches:
            white, deviation = whitener(_matrix(batch.column("x")))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), k))
            size = batch.num_rows * k
            cols = [
                batch.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(size, whitener.centre.n)),
                pa.array(deviation, pa.int64()).take(rows), pa.array(white.reshape(-1)), pa.array(np.tile(whitener.explained, batch.num_rows)), pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _OUT.split(", ")])

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vectors(vec_id, embedding)`` to a row for each row that takes part and each of its leading ``components``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = usable(vectors)
    fit = scratch.table(rows.select("x").distinct(), "fit")
    centre, cov = covariance(fit)
    whitener = Whitener(centre, cov, components) if centre else None
    if whitener is None or not len(whitener.values):
        scratch.drop()
        return spark.createDataFrame([], _OUT)
    error = identity_error(fit, whitener)
    scratch.drop()
    return rows.mapInArrow(_projected(whitener, error), _OUT)
