"""Pixel operators: byte kernels that a batch of blobs goes through, and the aggregates over what they emit.

A blob of bytes read as RGB triples is the pixel buffer here. Kernels aggregate inside a blob before anything is
shuffled, so no pixel ever is; groups that span blobs are partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.runtime import ship

Kernel = Callable[[np.ndarray], tuple]
#: Rows of a kernel's output that are kept before they are handed on.
ROWS = 1 << 16


def _over_blobs(kernel: Kernel, names: list[str], types: list[pa.DataType]):  # noqa: ANN202
    """Batches ``key, blob`` to those of the key and the kernel's columns, of about ``ROWS`` rows each."""

    def joined(keys: pa.Array, at: list[np.ndarray], parts: list[list]) -> pa.RecordBatch:
        flat = [pa.array([x for c in p for x in c], t) if pa.types.is_nested(t) or pa.types.is_string(t) or pa.types.is_binary(t) else pa.array(np.concatenate(p)).cast(t) for p, t in zip(parts, types)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(at))), *flat], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, parts, held = batch.column("key"), [], [[] for _ in types], 0
            for i, v in enumerate(batch.column("blob")):
                data = np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8)
                cols = kernel(data)
                n = len(cols[0])
                at.append(np.full(n, i))
                for p, c in zip(parts, cols):
                    p.append(c)
                held += n
                if held >= ROWS:
                    yield joined(keys, at, parts)
                    at, parts, held = [], [[] for _ in types], 0
            if at:
                yield joined(keys, at, parts)

    return run


def per_blob(df: DataFrame, key: str, blob: Column, kernel: Kernel, schema: str) -> DataFrame:
    """``kernel(bytes) -> equally long columns`` over each row's ``blob``; ``key`` is repeated for each output row.

    Null blobs count as empty; ``schema`` names the kernel's columns. A task holds ``ROWS`` rows of output, or those of one
    blob, besides a batch of blobs.
    """
    ship(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()
    out = df.sparkSession.createDataFrame([], schema).schema
    kinds = [f.dataType for f in out]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(k) for k in kinds]
    names = [f.name for f in out]

    return df.select(F.col(key).alias("key"), blob.alias("blob")).mapInArrow(_over_blobs(kernel, [key, *names], arrow), f"`{key}` {key_type}, {schema}")


def text_blob(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, which stand in for opaque file content."""
    return F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8")


# ---- histograms and colours ---------------------------------------------------------------------


def triples(data: np.ndarray) -> np.ndarray:
    return data[: len(data) // 3 * 3].reshape(-1, 3)


def luma(rgb: np.ndarray) -> np.ndarray:
    """Truncated 0.299 R + 0.587 G + 0.114 B, 255 at most."""
    v = 0.299 * rgb[:, 0].astype(float) + 0.587 * rgb[:, 1].astype(float) + 0.114 * rgb[:, 2].astype(float)
    return np.minimum(v.astype(np.int64), 255)


def _bins(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(values, minlength=1)
    at = np.flatnonzero(count)
    return at, count[at]


def luma_bins(df: DataFrame, key: str, blob: Column) -> DataFrame:
    """``key, bin, n``: each blob's luma histogram."""
    return per_blob(df, key, blob, lambda b: _bins(luma(triples(b))) if len(b) >= 3 else (np.zeros(0, int), np.zeros(0, int)), "bin long, n long")


def luma_histogram(df: DataFrame, key: str, blob: Column) -> DataFrame:
    """``bin, n`` over all blobs: at most 256 rows a task are shuffled."""
    return luma_bins(df, key, blob).groupBy("bin").agg(F.sum("n").alias("n"))


def channel_histograms(df: DataFrame, key: str, blob: Column) -> DataFrame:
    def kernel(b: np.ndarray) -> tuple:
        rgb, out = triples(b), []
        for c, name in enumerate("rgb"):
            at, n = _bins(rgb[:, c]) if len(rgb) else (np.zeros(0, int), np.zeros(0, int))
            out.append(([name] * len(at), at, n))
        return [x for o in out for x in o[0]], np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out])

    return per_blob(df, key, blob, kernel, "channel string, bin long, n long").groupBy("channel", "bin").agg(F.sum("n").alias("n"))


def _packed(b: np.ndarray) -> np.ndarray:
    rgb = triples(b).astype(np.int64)
    return rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]


def color_counts(df: DataFrame, key: str, blob: Column) -> DataFrame:
    """``key, rgb, n``: how often each colour occurs in a blob."""
    return per_blob(df, key, blob, lambda b: np.unique(_packed(b), return_counts=True), "rgb long, n long")


def distinct_colors(df: DataFrame, key: str, blob: Column) -> DataFrame:
    return per_blob(df, key, blob, lambda b: (np.array([len(np.unique(_packed(b)))]),), "colors long")


def top_colors(df: DataFrame, key: str, blob: Column, most: int) -> DataFrame:
    """Each blob's ``most`` frequent colours, ties by value, ranked inside the kernel."""

    def kernel(b: np.ndarray) -> tuple:
        rgb, n = np.unique(_packed(b), return_counts=True)
        order = np.lexsort((rgb, -n))[:most]
        return rgb[order], n[order], np.arange(1, len(order) + 1)

    return per_blob(df, key, blob, kernel, "rgb long, n long, rank long")


def luma_statistics(df: DataFrame, key: str, blob: Column) -> DataFrame:
    """Mean by integer division, and the range of bins that occur."""
    b = luma_bins(df, key, blob)
    return b.groupBy(key).agg(F.expr("sum(bin * n) div sum(n)").alias("mean"), F.min("bin").alias("low"), F.max("bin").alias("high"))


# ---- content statistics of the classifier -------------------------------------------------------


def nibbles(b: np.ndarray) -> np.ndarray:
    return np.stack([b >> 4, b & 15], 1).reshape(-1)


def nibble_statistics(df: DataFrame, key: str, blob: Column) -> DataFrame:
    """Chi-square of the 16 nibble counts against even ones, and how many nibbles exceed one percent."""

    def kernel(b: np.ndarray) -> tuple:
        if not len(b):
            return np.zeros(0), np.zeros(0, int)
        n = np.bincount(nibbles(b), minlength=16).astype(float)
        even = n.sum() / 16
        return np.array([round(float(((n - even) ** 2 / even).sum()), 6)]), np.array([(n > n.sum() / 100).sum()])

    return per_blob(df, key, blob, kernel, "chi_square double, frequent long")


def bit_statistics(df: DataFrame, key: str, blob: Column) -> DataFrame:
    """Bit transitions inside bytes, bytes whose pairs are mixed, and solid bytes."""

    def kernel(b: np.ndarray) -> tuple:
        v = b.astype(np.int64)
        change = np.unpackbits(((v ^ (v >> 1)) & 127).astype(np.uint8)).sum()
        pairs = np.stack([v >> 6 & 3, v >> 4 & 3, v >> 2 & 3, v & 3], 1) if len(v) else np.zeros((0, 4), int)
        return np.array([int(change)]), np.array([((pairs == 1) | (pairs == 2)).sum()]), np.array([((v == 0) | (v == 255)).sum()])

    return per_blob(df, key, blob, kernel, "transitions long, mixed long, solid long")


def row_correlation(df: DataFrame, key: str, blob: Column, width: int) -> DataFrame:
    """Of bytes with one above them, how many differ from it by less than 64."""

    def kernel(b: np.ndarray) -> tuple:
        v = b.astype(np.int64)
        near = np.abs(v[width:] - v[:-width]) < 64 if len(v) > width else np.zeros(0, bool)
        return np.array([len(near)]), np.array([near.sum()])

    return per_blob(df, key, blob, kernel, "pairs long, near long")


def block_scores(df: DataFrame, key: str, blob: Column, block: int = 2048, head: int = 100) -> DataFrame:
    """Blocks whose first bytes hold more than 50 different values, and zero bytes in the first kilobyte."""

    def kernel(b: np.ndarray) -> tuple:
        rich = sum(len(np.unique(b[i : i + head])) > 50 for i in range(0, len(b), block))
        return np.array([rich]), np.array([(b[:1024] == 0).sum()])

    return per_blob(df, key, blob, kernel, "rich_blocks long, early_zeros long")


# ---- colours from bits and cells ----------------------------------------------------------------


def artifact_colors(line: np.ndarray) -> np.ndarray:
    """Hi-res colours of lines of bytes, seven columns a byte: 0 and 1 where a bit is as the next one of its line, else one of 2
    to 5 by bit, column parity and the byte's high bit. Behind a line's end bits are 0."""
    on = ((line[:, :, None] >> np.arange(7, dtype=np.uint8)) & 1).reshape(len(line), -1)
    after = np.concatenate([on[:, 1:], np.zeros((len(line), 1), np.uint8)], 1)
    high, odd = np.repeat(line >> 7, 7, 1), np.arange(on.shape[1]) % 2
    lone = np.where(high, np.where(odd == on, 4, 5), np.where(odd == on, 2, 3))
    return np.where(on == after, on, lone)


def _artifact_table() -> np.ndarray:
    """How often each colour comes out of a byte, by parity of its place, next bit and value."""
    value, bit = np.repeat(np.arange(256, dtype=np.uint8), 2), np.tile(np.arange(2, dtype=np.uint8), 256)
    shown = [artifact_colors(np.stack([np.zeros_like(value)] * k + [value, bit], 1))[:, 7 * k : 7 * k + 7] for k in range(2)]
    return np.concatenate([(x[:, :, None] == np.arange(6)).sum(1) for x in shown])


def artifact_counts(df: DataFrame, key: str, blob: Column, width: int = 40) -> DataFrame:
    """``color, n`` of each blob as lines of ``width`` bytes, an even number, of which the last may be short."""
    table = _artifact_table()

    def kernel(b: np.ndarray) -> tuple:
        at = np.arange(len(b))
        bit = np.append(b[1:] & 1, np.zeros(1, np.uint8))[: len(b)] * (at % width != width - 1)
        n = np.bincount((at & 1) * 512 + b.astype(np.int64) * 2 + bit, minlength=1024) @ table
        return np.flatnonzero(n), n[n > 0]

    return per_blob(df, key, blob, kernel, "color long, n long")


def cell_inks(df: DataFrame, key: str, blob: Column, cell: int) -> DataFrame:
    """Cells of ``cell`` bytes whose first is the attribute that gives each other one of two colours of three bits: by
    attribute how many bytes have it, and the sum of their colours."""

    def kernel(b: np.ndarray) -> tuple:
        v, at = b.astype(np.int64), np.arange(len(b))
        a = v[at // cell * cell]
        keep = at % cell > 0
        ink = np.where(v >= a, a % 8, a // 8 % 8)[keep]
        n = np.bincount(a[keep], minlength=256)
        return np.flatnonzero(n), n[n > 0], np.bincount(a[keep], ink, 256)[n > 0].astype(np.int64)

    return per_blob(df, key, blob, kernel, "attribute long, n long, ink long")


def used_nibbles(df: DataFrame, key: str, blob: Column) -> DataFrame:
    """The palette indices that a blob of two pixels a byte uses, as text in the order of their decimal spelling."""
    return per_blob(df, key, blob, lambda b: ([",".join(sorted(str(v) for v in np.flatnonzero(np.bincount(nibbles(b), minlength=16))))],), "used string")


def filled_slices(b: np.ndarray, size: int, blank: tuple[int, ...], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the whole slices of ``size`` bytes with more than ``least`` that are not ``blank``, and how many these are."""
    filled = (~np.isin(grid(b, size), blank)).sum(1)
    at = np.flatnonzero(filled > least)
    return at * size, filled[at]


# ---- geometry and tone --------------------------------------------------------------------------


def checksums(df: DataFrame, key: str, blob: Column, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A position-weighted sum over each changed blob, which tells every change of place or value."""

    def kernel(b: np.ndarray) -> tuple:
        v = change(b).astype(np.int64)
        return np.array([len(v)]), np.array([int((v * (np.arange(len(v)) % 251 + 1)).sum())])

    return per_blob(df, key, blob, kernel, "bytes long, weighted long")


def grid(b: np.ndarray, width: int) -> np.ndarray:
    return b[: len(b) // width * width].reshape(-1, width)


def rotate(image: np.ndarray, quarter_turns_ccw: int = 1) -> np.ndarray:
    return np.rot90(image, quarter_turns_ccw)


def flip(image: np.ndarray, horizontal: bool) -> np.ndarray:
    return image[:, ::-1] if horizontal else image[::-1]


def invert(image: np.ndarray) -> np.ndarray:
    return 255 - image


def crop(image: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> np.ndarray | None:
    """The part between two corners (x, y) in any order; None if it is empty."""
    (x0, x1), (y0, y1) = sorted((start[0], end[0])), sorted((start[1], end[1]))
    h, w = image.shape[:2]
    x0, x1, y0, y1 = max(0, x0), min(w, x1), max(0, y0), min(h, y1)
    return image[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else None


def adjust(image: np.ndarray, brightness: float = 0.0, contrast: float = 0.0) -> np.ndarray:
    """Contrast around 128, then brightness: truncated and clamped; both lie in -1..1."""
    k = 1 + 3 * contrast if contrast >= 0 else 1 + contrast
    return np.clip(np.trunc((image.astype(float) - 128) * k + 128 + 255 * brightness), 0, 255).astype(np.uint8)


def upscale(image: np.ndarray, factor: int) -> np.ndarray:
    return image if factor == 1 else np.repeat(np.repeat(image, factor, 0), factor, 1)


def resize_nearest(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    return image[np.arange(height) * h // height][:, np.arange(width) * w // width]


# ---- long form ----------------------------------------------------------------------------------


def hold_and_modify(events: DataFrame, group: str, order: list[str], control: Column, value: Column) -> DataFrame:
    """Sequential colour state as windows: control 0 sets all channels, 1 blue, 2 red, 3 green."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = events
    for name, own in (("b", 1), ("r", 2), ("g", 3)):
        out = out.withColumn(name, F.coalesce(F.last(F.when(control.isin(0, own), value), ignorenulls=True).over(w), F.lit(0).cast("long")))
    return out
