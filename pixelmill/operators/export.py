"""Names, export plans, PNG files and the slide show's time line."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.pixels import resize_nearest, upscale
from pixelmill.runtime import settled, ship, unused
from pixelmill.sources.store import files_in, write_files

# Fixed values of the slide show: frames a second, and frames of a transition.
FPS, TRANSITION = 30, 15
CUTS = 256  # keys at which a whole list is cut for numbering
TRANSITIONS = "none fade slide_left slide_right slide_up slide_down wipe_left wipe_right zoom_in zoom_out".split()


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def in_ranges(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with the number of the range of ``order`` that each is in.

    Ranges are cut at ``CUTS`` keys, those with the smallest hashes. Equal keys share a range.
    """
    key, cuts = unused(rows, "key", "cuts")
    keyed = rows.withColumn(key, F.struct(*order))
    at = keyed.select(key).orderBy(F.xxhash64(key), key).limit(CUTS).agg(F.array_sort(F.collect_set(key)).alias(cuts))
    return keyed.crossJoin(F.broadcast(at)).withColumn(name, F.size(F.filter(cuts, lambda c: c < F.col(key)))).drop(cuts, key)


def numbered(images: DataFrame, order: list[str], by: list[str] | None = None, name: str = "n", large: bool = False) -> DataFrame:
    """The 1-based place of each image in its group, or in the whole list.

    The whole list, and groups too if they may be ``large``, are cut into ranges that are numbered side by side; each
    starts after the counts of those before it, so no task sorts a list. The rows and their order have to be stable.
    """
    if by and not large:
        return images.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    by = by or []
    part, size, first, *keys = unused(images, "range", "size", "first", *[f"by{i}" for i in range(len(by))])
    ranged = in_ranges(images, order, part)
    before = F.sum(size).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # over CUTS + 1 rows of a group at most
    firsts = ranged.groupBy(*by, part).agg(F.count("*").alias(size)).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(part).alias(size), F.coalesce(before, F.lit(0)).alias(first))
    place = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))
    same = F.col(part) == F.col(size)
    for b, k in zip(by, keys):
        same = same & F.col(b).eqNullSafe(F.col(k))
    joined = ranged.join(firsts if by else F.broadcast(firsts), same)
    return joined.withColumn(name, (place + F.col(first)).cast("long")).drop(part, size, first, *keys)


_COUNTED = r"^(.*) \(([1-9][0-9]{0,17})\)$"
#: Places of a name's copies whose numbers are told from one list.
SPAN = 1024


def unique_names(files: DataFrame, order: list[str], name: str = "out_name", taken: DataFrame | None = None) -> DataFrame:
    """``files`` with every ``name`` made unique: the first of equal names, in order, keeps it, the k-th becomes ``stem (k).ext``.

    Numbers are passed over whose name another file has by itself, or a file of ``taken(name)``, say of the folder that is
    written to; a name that is taken is not kept. Names are compared as they are. Runs on the same rows agree.

    Names with a number differ from those that others get: a text ends in one `` (k)`` only, so equal ones come from one
    name and one k. They can only meet names that are there from the start, and those are left out beforehand: the j-th
    file of a name gets the j-th number that is free. With the numbers that are not free, b_1 < b_2 < ..., that is j plus
    how many i have ``b_i - i < j``. These are looked up by spans of j, so that a name which a third of all files have, or
    of which a third of all numbers are taken, is dealt over tasks.
    """
    j, span, steps, above, stem, ext, key, at = unused(files, "j", "span", "steps", "above", "stem", "ext", "key", "at")
    placed = numbered(files, order, [name], j, large=True).withColumn(span, F.floor((F.col(j) - 1) / SPAN))

    there = files.select(F.col(name).alias("n")).distinct().withColumn("fresh", F.lit(False))
    if taken is not None:
        there = there.unionByName(taken.select(F.col(taken.columns[0]).alias("n"), F.lit(True).alias("fresh"))).groupBy("n").agg(F.max("fresh").alias("fresh"))
    there = there.withColumn("stem", base_name(F.col("n")))
    suffix = F.expr("substring(n, length(stem) + 1)")
    counted = there.select(F.concat(F.regexp_extract("stem", _COUNTED, 1), suffix).alias("of"), F.regexp_extract("stem", _COUNTED, 2).alias("k")).where("k <> '' and k <> '1'")
    blocked = counted.select("of", F.col("k").cast("long").alias("k")).unionByName(there.where("fresh").select(F.col("n").alias("of"), F.lit(1).cast("long").alias("k")))
    groups = files.groupBy(F.col(name).alias("of")).agg(F.count("*").alias("many"))
    # Steps: from j > edge on, at least ``passed`` numbers are passed over.
    ranked = numbered(blocked.join(groups, "of"), ["k"], ["of"], "i", large=True).withColumn("edge", F.col("k") - F.col("i")).where("edge < many")
    edges = ranked.groupBy("of", "edge", "many").agg(F.max("i").alias("passed")).withColumn("span", F.floor(F.col("edge") / SPAN))
    lists = edges.groupBy("of", "span", "many").agg(F.array_sort(F.collect_list(F.struct("edge", "passed"))).alias("list"), F.max("passed").alias("most"))  # SPAN edges at most
    spans = edges.select("of", "many").distinct().select("of", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / SPAN))).alias("span"))
    before = F.max("most").over(Window.partitionBy("of").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    lookup = spans.join(lists.drop("many"), ["of", "span"], "left").select(F.col("of").alias(key), F.col("span").alias(at), F.col("list").alias(steps), F.coalesce(before, F.lit(0)).alias(above))

    joined = placed.join(lookup, (F.col(name) == F.col(key)) & (F.col(span) == F.col(at)), "left")
    inside = F.array_max(F.transform(F.filter(steps, lambda s: s["edge"] < F.col(j)), lambda s: s["passed"]))
    number = F.col(j) + F.coalesce(inside, F.col(above), F.lit(0))
    named = joined.withColumn(stem, base_name(F.col(name))).withColumn(ext, F.expr(f"substring(`{name}`, length(`{stem}`) + 1)"))
    out = F.when(number == 1, F.col(name)).otherwise(F.concat(F.col(stem), F.lit(" ("), number.cast("string"), F.lit(")"), F.col(ext)))
    return named.withColumn(name, F.when(F.col(name).isNotNull(), out)).select(*[f"`{c}`" for c in files.columns])


def renamed(images: DataFrame, pattern: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """``out_name`` from a pattern with ``{n}``, the 1-based place (in its group), and ``{name}``, the base name."""
    (place,) = unused(images, "n")
    n = F.col(place).cast("string")
    named = F.replace(F.replace(F.lit(pattern), F.lit("{n}"), n), F.lit("{name}"), base_name(F.col("name")))
    return numbered(images, order, by, place).withColumn("out_name", named).drop(place)


def screensaver_names(images: DataFrame, order: list[str]) -> DataFrame:
    """``out_name`` of a screensaver's files: the place in three digits and the name, which sort as they are shown."""
    (place,) = unused(images, "n")
    return numbered(images, order, name=place).withColumn("out_name", F.format_string("%03d_%s.png", place, base_name(F.col("name")))).drop(place)


def export_plan(images: DataFrame, formats: list[str]) -> DataFrame:
    """Every image in every format, and how many would share a file; ``original`` goes with no other format."""
    if "original" in formats and len(formats) > 1:
        raise ValueError("the original format excludes the others")
    if "heic" in formats:
        raise ValueError("HEIC cannot be written: there is no encoder")
    each = images.withColumn("format", F.explode(F.array(*(F.lit(f) for f in formats))))
    each = each.withColumn("out_name", F.concat(base_name(F.col("name")), F.lit("."), F.col("format")))
    return each.withColumn("sharing", F.count("*").over(Window.partitionBy("out_name")))


def size_label(size: Column) -> Column:
    """``512 B``, ``1.5 KB`` or ``2.0 MB``; of a tie the even digit is shown."""
    kb, mb = F.lit(1024), F.lit(1024 * 1024)
    shown = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(size / unit, 1))
    return F.when(size < kb, F.concat(size, F.lit(" B"))).when(size < mb, shown(kb, "KB")).otherwise(shown(mb, "MB"))


def name_with_type(name: Column, file_type: Column, aux: Column) -> Column:
    """``name#tttaaaa`` in lower-case hexadecimal."""
    return F.concat(name, F.format_string("#%02x%04x", file_type, aux))


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG file."""
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], 1).tobytes()
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tiff(rgb: np.ndarray) -> bytes:
    """An uncompressed 8-bit RGB TIFF file of one strip."""
    h, w = rgb.shape[:2]
    start = 8 + 2 + 9 * 12 + 4 + 6
    entries = ((256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, start - 6), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, start), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, w * h * 3))
    return struct.pack("<2sHIH", b"II", 42, 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<IHHH", 0, 8, 8, 8) + rgb.tobytes()


ENCODERS = {"png": png, "tiff": tiff}


def png_files(images: DataFrame, factor: int = 1) -> DataFrame:
    return image_files(images, "png", factor)


def image_files(images: DataFrame, kind: str, factor: int = 1) -> DataFrame:
    """``images(name, width, height, pixels)`` to ``name, content``, scaled by nearest neighbour, on the executors."""
    ship(images.sparkSession)
    encode = ENCODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [encode(upscale(np.frombuffer(p, np.uint8).reshape(h, w, 3), factor)) for w, h, p in zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("pixels").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.binary())], names=["name", "content"])

    return images.select(base_name(F.col("name")).alias("name"), "width", "height", "pixels").mapInArrow(run, "name string, content binary")


def offset_before(size: Column, group: list[str], order: list[str]) -> Column:
    """The sum of the sizes in front of each row of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long")


def save_files(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Writes ``files(name, content)`` below ``folder``, all of them or none (``sources.store``), and gives ``name, bytes`` of what then lies there."""
    write_files(files, folder, overwrite)
    return files_in(files.sparkSession, folder).select("name", F.col("size").alias("bytes"))


def export_images(images: DataFrame, folder: str, kinds: list[str], order: list[str], factor: int = 1, overwrite: bool = False) -> None:
    """Writes ``images(name, width, height, pixels)`` in each of ``kinds`` under names that are unique and, without ``overwrite``, new in ``folder``."""
    named = unique_names(export_plan(images, kinds).drop("sharing"), [*order, "format"], taken=None if overwrite else _names_in(images, folder))
    parts = [image_files(named.where(F.col("format") == kind).withColumn("name", F.concat("out_name", F.lit(".x"))), kind, factor) for kind in kinds]
    write_files(reduce(DataFrame.unionByName, parts), folder, overwrite)


def _names_in(df: DataFrame, folder: str) -> DataFrame | None:
    try:
        return settled(files_in(df.sparkSession, folder).select("name"))  # as it is before anything is written
    except AnalysisException:
        return None  # there is no such folder yet


# Extensions of catalogue entries without one, by file type.
ENTRY_EXT = {0x00: "txt", 0x01: "txt", 0x02: "bas", 0x04: "bin", 0x06: "bin", 0xFA: "bas", 0xFC: "bas"}


def entry_file_name(name: Column, file_type: Column) -> Column:
    """The name that a catalogue entry is written under: its own or, without a dot, with an extension for its type."""
    ext = F.lit("dat")
    for kind, text in ENTRY_EXT.items():
        ext = F.when(file_type == kind, text).otherwise(ext)
    return F.when(name.contains("."), name).otherwise(F.concat(name, F.lit("."), ext))


def export_entries(entries: DataFrame, chosen: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes the files among the chosen ``(disk_path, entry_path)`` of ``entries`` (``sources.disks``), each under a name of its own."""
    files = entries.where(~F.col("is_directory")).join(chosen.select("disk_path", "entry_path").distinct(), ["disk_path", "entry_path"], "left_semi")
    named = files.withColumn("out_name", F.replace(entry_file_name(F.col("name"), F.col("file_type")), F.lit("/"), F.lit(":")))
    named = unique_names(named, ["disk_path", "entry_path", "ord"], taken=None if overwrite else _names_in(entries, folder))
    write_files(named.select(F.col("out_name").alias("name"), "content"), folder, overwrite)


def timeline(images: DataFrame, group: list[str], order: list[str], seconds: float, transition: bool = True, key: str | None = None) -> DataFrame:
    """Frames that each image is shown and blended to the next, and the first frame of each; ``next_key`` is the next's ``key``."""
    w = Window.partitionBy(*group).orderBy(*order)
    change = F.when(F.lead(F.lit(1)).over(w).isNotNull() & F.lit(transition), TRANSITION).otherwise(0)
    shown = images.withColumn("changing", change).withColumn("shown", F.greatest(F.lit(1), F.lit(int(seconds * FPS)) - F.col("changing")))
    if key is not None:
        shown = shown.withColumn("next_key", F.lead(key).over(w))
    return shown.withColumn("first_frame", offset_before(F.col("shown") + F.col("changing"), group, order))


#: Frames of a bucket of the join of frames with what is shown.
BUCKET = 4096


def frame_numbers(times: DataFrame, group: list[str], every: int = 1) -> DataFrame:
    """``group, frame``: every ``every``-th frame of each movie of a ``timeline``, from the first."""
    length = times.groupBy(*group).agg(F.max(F.col("first_frame") + F.col("shown") + F.col("changing")).alias("n"))
    return length.select(*group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(every).cast("long"))).alias("frame"))


def frames_at(wanted: DataFrame, times: DataFrame, group: list[str], key: str) -> DataFrame:
    """``wanted(group, frame)`` with ``key``, the image shown, and ``next_key, alpha`` while it is blended to the next, else null and 0.

    Frames outside the movie have no row. Both sides meet by buckets of frames, so that a long movie is many groups, and a
    row of the time line is repeated only for the buckets it reaches over. Neither side is broadcast: the size that Spark
    expects of the frames does not know how many ``frame_numbers`` makes of a row.
    """
    end = F.col("first_frame") + F.col("shown") + F.col("changing")
    bucket = F.floor(F.col("first_frame") / BUCKET)
    spread = times.withColumn("end", end).withColumn("bucket", F.explode(F.sequence(bucket, F.floor((end - 1) / BUCKET))))
    asked = wanted.select(*group, "frame").withColumn("bucket", F.floor(F.col("frame") / BUCKET))
    met = asked.hint("merge").join(spread.hint("merge"), [*group, "bucket"]).where((F.col("frame") >= F.col("first_frame")) & (F.col("frame") < F.col("end")))
    t = F.col("frame") - F.col("first_frame") - F.col("shown") + 1
    blending = t > 0
    alpha = F.when(blending, t.cast("double") / TRANSITION).otherwise(0.0)
    return met.select(*group, "frame", F.col(key), F.when(blending, F.col("next_key")).alias("next_key"), alpha.alias("alpha"))


def rendered(frames: DataFrame, images: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """The pictures of ``frames_at``: ``key, next_key, alpha, width, height, pixels``, each that several frames show once.

    ``images(key, width, height, pixels)`` are joined to pictures, not to frames.
    """
    shown = frames.select(key, "next_key", "alpha").distinct()
    first = images.select(key, "width", "height", "pixels")
    second = images.select(F.col(key).alias("next_key"), F.col("width").alias("w2"), F.col("height").alias("h2"), F.col("pixels").alias("p2"))
    both = shown.join(first, key).join(second, "next_key", "left")
    both = both.select(key, "next_key", "alpha", "width", "height", "pixels", F.coalesce("w2", "width").alias("next_width"), F.coalesce("h2", "height").alias("next_height"), F.coalesce("p2", "pixels").alias("next_pixels"))
    drawn = blended(both.withColumn("kept_alpha", F.col("alpha")), width, height)
    return drawn.withColumnRenamed("kept_alpha", "alpha").select(key, "next_key", "alpha", "width", "height", "pixels")


def duration_text(seconds: Column) -> Column:
    """``3m 7s``, or ``7s`` below a minute."""
    whole = F.floor(seconds).cast("long")
    rest = F.concat((whole % 60).cast("string"), F.lit("s"))
    return F.when(whole >= 60, F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), rest)).otherwise(rest)


def blend(first: np.ndarray, second: np.ndarray, alpha: float, width: int, height: int) -> np.ndarray:
    """Both images fitted into a black box by nearest neighbour, the second drawn with ``alpha`` over the first with the rest."""
    out = np.zeros((height, width, 3))
    for image, weight in ((first, 1 - alpha), (second, alpha)):
        k = min(width / image.shape[1], height / image.shape[0])
        w, h = max(1, int(image.shape[1] * k)), max(1, int(image.shape[0] * k))
        x, y = (width - w) // 2, (height - h) // 2
        part = out[y : y + h, x : x + w]
        part *= 1 - weight
        part += resize_nearest(image, w, h) * weight
    return np.round(out).astype(np.uint8)


def blended(pairs: DataFrame, width: int, height: int) -> DataFrame:
    """``pairs(width, height, pixels, next_width, next_height, next_pixels, alpha, ...)`` with one frame in place of the two images."""
    ship(pairs.sparkSession)
    used = ("width", "height", "pixels", "next_width", "next_height", "next_pixels", "alpha")
    kept = [f for f in pairs.schema if f.name not in used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames = []
            for w, h, p, nw, nh, q, alpha in zip(*(b.column(c).to_pylist() for c in used)):
                frames.append(blend(np.frombuffer(p, np.uint8).reshape(h, w, 3), np.frombuffer(q, np.uint8).reshape(nh, nw, 3), alpha, width, height).tobytes())
            n = len(frames)
            cols = [*(b.column(f.name) for f in kept), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), "width", "height", "pixels"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "width int, height int, pixels binary"])
    return pairs.mapInArrow(run, schema)


def transition_frame(kind: Column, t: Column, width: int, height: int) -> Column:
    """Opacity, shift and zoom of the next image at progress ``t`` of a transition."""
    slide = {"slide_left": (width, 0), "slide_right": (-width, 0), "slide_up": (0, height), "slide_down": (0, -height)}
    alpha, dx, dy, zoom = F.when(kind.isin("fade", "zoom_in", "zoom_out"), t), F.lit(0.0), F.lit(0.0), F.when(kind == "zoom_in", t).when(kind == "zoom_out", 2 - t)
    for name, (x, y) in slide.items():
        dx, dy = F.when(kind == name, (1 - t) * x).otherwise(dx), F.when(kind == name, (1 - t) * y).otherwise(dy)
    clip = F.when(kind.isin("wipe_left", "wipe_right"), t)
    return F.struct(F.coalesce(alpha, F.lit(1.0)).alias("alpha"), dx.alias("dx"), dy.alias("dy"), F.coalesce(clip, F.lit(1.0)).alias("clip"), F.coalesce(zoom, F.lit(1.0)).alias("zoom"))


def random_transition(key: Column, seed: int = 0) -> Column:
    """One of the transitions by a hash of the key, the same on every run."""
    return F.element_at(F.array(*(F.lit(t) for t in TRANSITIONS)), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(TRANSITIONS))).cast("int") + 1)


def letterbox(width: Column, height: Column, box_w: int, box_h: int) -> Column:
    """Size and place of an image scaled into a box."""
    k = F.least(F.lit(float(box_w)) / width, F.lit(float(box_h)) / height)
    return F.struct((width * k).alias("w"), (height * k).alias("h"), ((box_w - width * k) / 2).alias("x"), ((box_h - height * k) / 2).alias("y"))
