"""Files to images: classify, decode once, keep pixels as one binary, and what follows from the pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions.binary import extension
from pixelmill.operators import pixels as P
from pixelmill.operators.classify import classify, is_disk
from pixelmill.operators.decoders import Picture, decode
from pixelmill.operators.filetypes import entry_kernel, entry_name, without_header
from pixelmill.runtime import ship, unused
from pixelmill.sources.disks import disk_entries
from pixelmill.sources.raw import modern_images, raw_files

IMAGE = "kernel string, family string, mode string, width int, height int, pixels binary, palette array<int>, editable boolean"
NAMES = tuple(f.split()[0] for f in IMAGE.split(", "))


def _image(kernel: str | None, content: bytes | None, palette: list[int] | None = None) -> dict | None:
    p: Picture | None = decode(kernel, content) if kernel and content else None
    if p is None:
        return None
    table = None
    if palette is not None and p.editable and p.palettes is not None:
        flat = np.array(palette, np.int64)
        table = np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], 1).astype(np.uint8).reshape(len(p.palettes), -1, 3)
    rgb = p.colors(table)
    use = None if p.palettes is None else (p.palettes if table is None else table).reshape(-1, 3).astype(np.int64)
    codes = None if use is None else (use[:, 0] << 16 | use[:, 1] << 8 | use[:, 2]).tolist()
    return {"kernel": kernel, "family": p.family, "mode": p.mode, "width": rgb.shape[1], "height": rgb.shape[0], "pixels": rgb.tobytes(), "palette": codes, "editable": p.editable}


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kernel", pa.string()), ("family", pa.string()), ("mode", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("palette", pa.list_(pa.int32())), ("editable", pa.bool_())])
    for batch in batches:
        own = batch.column("modified").to_pylist()
        out = [_image(k, c, m) for k, c, m in zip(batch.column("kernel").to_pylist(), batch.column("content").to_pylist(), own)]
        rest = [c for c in batch.schema.names if c not in ("kernel", "content", "modified")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, kind)], names=[*rest, "image"])


def decoded(files: DataFrame, modified: Column | None = None, kernel: Column | None = None) -> DataFrame:
    """``files(name, content, ...)`` to one row per file that decodes, with the columns of ``IMAGE``.

    ``modified`` is a palette of 0xRRGGBB numbers to show the index map with instead of the file's own; ``kernel`` names
    the kernels of files that the classifier is not asked about. Modern formats are left to ``opened``.
    """
    ship(files.sparkSession)
    known = classify(files, kernel).where("kernel is not null and kernel <> 'modern'")
    known = known.withColumn("modified", F.lit(None).cast("array<int>") if modified is None else modified)
    rest = [f for f in known.schema if f.name not in ("kernel", "content", "modified")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    out = known.mapInArrow(_decode, f"{schema}, image struct<{IMAGE.replace(' ', ':').replace(',:', ',')}>").where("image is not null")
    return out.select(*[f"`{f.name}`" for f in rest], "image.*")


def imported(entries: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Entries of disk images (``disk_entries``) that decode, as images; only those of ``chosen(disk_path, entry_path)`` if given."""
    files = entries.where(~F.col("is_directory") & (F.length("content") > 0))
    if chosen is not None:
        files = files.join(chosen.select("disk_path", "entry_path").distinct(), ["disk_path", "entry_path"], "left_semi")
    seen = entry_name(F.col("disk_format"), F.col("name"), F.col("file_type"), F.col("load_address"))
    files = files.withColumn("content", without_header(F.col("file_type"), F.col("content")))
    return decoded(files, kernel=entry_kernel(F.col("disk_format"), F.col("disk_name"), seen, F.col("content")))


def _as_rgb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for n, p in zip(b.column("channels").to_pylist(), b.column("pixels")):
            v = np.frombuffer(p.as_buffer(), np.uint8).reshape(-1, n)
            out.append((np.repeat(v, 3, 1) if n == 1 else v[:, 2::-1]).tobytes())
        rest = ["path", "width", "height"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, pa.binary())], names=[*rest, "pixels"])


def opened(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, name`` and the columns of ``IMAGE`` of all images below ``paths``: old formats by their kernels, modern ones by
    the built-in image source, entries of disk images as ``disk!entry``."""
    ship(spark)
    files = raw_files(spark, *paths)
    disk = is_disk(F.col("name"), F.col("content"))
    old = decoded(files.where(~disk)).select("path", "name", *NAMES)
    inside = imported(disk_entries(files.where(disk))).select(F.concat("disk_path", F.lit("!"), "entry_path").alias("path"), "name", *NAMES)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    wanted = classify(files.where(~disk)).where("kernel = 'modern'").select(plain("path").alias("path"), "name")
    pixels = modern_images(spark, *paths).mapInArrow(_as_rgb, "path string, width int, height int, pixels binary").withColumn("path", plain("path"))
    modern = pixels.join(wanted, "path").select(
        "path", "name", F.lit("modern").alias("kernel"), F.lit("Modern").alias("family"), F.upper(extension(F.col("name"))).alias("mode"), "width", "height", "pixels",
        F.lit(None).cast("array<int>").alias("palette"), F.lit(False).alias("editable"),
    )
    return old.unionByName(inside).unionByName(modern)


def transformed(images: DataFrame, *steps: tuple, where: Column | None = None) -> DataFrame:
    """``images(width, height, pixels, ...)`` with the steps applied in turn to those that ``where`` chooses (all by default).

    A step is the name of a pixel operator and its arguments: ``("rotate", 1)``, ``("flip", True)``, ``("invert",)``,
    ``("crop", (x, y), (x, y))``, ``("adjust", brightness, contrast)``, ``("upscale", factor)``. A crop that leaves nothing
    leaves the image as it is.
    """
    ship(images.sparkSession)
    (mark,) = unused(images, "chosen")
    chosen = images.withColumn(mark, F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    runs = [(getattr(P, name), args) for name, *args in steps if name in ("rotate", "flip", "invert", "crop", "adjust", "upscale")]
    if len(runs) < len(steps):
        raise ValueError("unknown step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names if c != mark}
            w, h, out = cols["width"].to_pylist(), cols["height"].to_pylist(), []
            for i, (take, p) in enumerate(zip(b.column(mark).to_pylist(), cols["pixels"])):
                v = None if p.as_py() is None else np.frombuffer(p.as_buffer(), np.uint8).reshape(h[i], w[i], 3)
                for f, args in runs if take and v is not None else ():
                    changed = f(v, *args)
                    v = v if changed is None else changed
                if v is not None:
                    h[i], w[i] = v.shape[:2]
                out.append(None if v is None else v.tobytes())
            cols |= {"width": pa.array(w, pa.int32()), "height": pa.array(h, pa.int32()), "pixels": pa.array(out, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return chosen.mapInArrow(run, images.schema)


def hex_color(red: Column, green: Column, blue: Column) -> Column:
    """``#RRGGBB``."""
    return F.format_string("#%02X%02X%02X", red, green, blue)


def with_color(palette: Column, index: int, rgb: int) -> Column:
    """The palette with one colour replaced; as it was if there is no such index."""
    return F.transform(palette, lambda c, i: F.when(i == index, F.lit(rgb)).otherwise(c))


def palette_for_line(palette: Column, colors: int, line_map: Column, y: Column) -> Column:
    """The slice of a picture's palettes that scan line ``y`` uses."""
    return F.slice(palette, F.coalesce(F.get(line_map, y), F.lit(0)) * colors + 1, F.lit(colors))
