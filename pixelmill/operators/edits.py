"""Selections, undo, palettes and recently used lists as joins and windows over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.export import in_ranges
from pixelmill.runtime import unused

UNDO_DEPTH, RECENT = 10, 10


def _key(seq: str | list[str]) -> Column:
    """What orders a log: one column, or several as a struct."""
    return F.struct(*([seq] if isinstance(seq, str) else seq))


def selected(images: DataFrame, selection: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(selection.select(key), key, "left_semi")


def selected_or_current(images: DataFrame, selection: DataFrame, current: str | None, key: str = "image_id") -> DataFrame:
    """What an export takes: the selection if there is one, else the current image, else all."""
    some = selection.select(F.lit(1).alias("_some")).limit(1)
    rest = images if current is None else images.where(F.col(key) == current)
    return selected(images, selection, key).unionByName(rest.join(F.broadcast(some), how="left_anti"))


def deleted(images: DataFrame, selection: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(selection.select(key), key, "left_anti")


def appended(images: DataFrame, more: DataFrame) -> DataFrame:
    """Further images behind those that are there, by column name; nothing is compared."""
    return images.unionByName(more)


def cleared(rows: DataFrame) -> DataFrame:
    """No images, selections or recent paths, with the columns as they were."""
    return rows.where(F.lit(False))


def first_wins(images: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Of images with one key the first in order."""
    w = Window.partitionBy(key).orderBy(*order)
    (k,) = unused(images, "k")
    return images.withColumn(k, F.row_number().over(w)).where(F.col(k) == 1).drop(k)


def toggled(clicks: DataFrame, key: str = "image_id") -> DataFrame:
    """Ids that were clicked an odd number of times."""
    return clicks.groupBy(key).agg((F.count("*") % 2).alias("odd")).where("odd = 1").select(key)


def undo_log(edits: DataFrame, key: str = "image_id", seq: str | list[str] = "seq", place: str | None = None) -> DataFrame:
    """The latest ``UNDO_DEPTH`` edits of each image; ``place`` names their place from the latest, if wanted."""
    w = Window.partitionBy(key).orderBy(_key(seq).desc())
    (k,) = unused(edits, "k")
    out = edits.withColumn(k, F.row_number().over(w).cast("long")).where(F.col(k) <= UNDO_DEPTH)
    return out.drop(k) if place is None else out.withColumnRenamed(k, place)


def undone(edits: DataFrame, live: DataFrame, key: str = "image_id", seq: str | list[str] = "seq") -> DataFrame:
    """The log without each live image's last edit."""
    (at,) = unused(edits, "last")
    last = edits.join(live.select(key), key, "left_semi").groupBy(key).agg(F.max(_key(seq)).alias(at))
    return edits.withColumn(at, _key(seq)).join(last, [key, at], "left_anti").drop(at)


def pending(log: DataFrame, is_reset: Column, key: str = "image_id", seq: str | list[str] = "seq") -> DataFrame:
    """The edits since the last reset of each image, such as adjustments that are previewed; all where there was none.

    Resets are found first, one for each image, and joined to the log: no image's edits come together in a task.
    """
    at, reset, own = unused(log, "reset", "is_reset", "key")
    marked = log.withColumn(reset, F.coalesce(is_reset, F.lit(False)))
    last = marked.where(reset).groupBy(F.col(key).alias(own)).agg(F.max(_key(seq)).alias(at))
    edits = marked.where(~F.col(reset)).join(last, F.col(key).eqNullSafe(F.col(own)), "left")
    return edits.where(F.col(at).isNull() | (_key(seq) > F.col(at))).drop(at, reset, own)


def recent(visits: DataFrame, key: str = "path", seq: str | list[str] = "seq") -> DataFrame:
    """The ``RECENT`` keys used last, latest first."""
    last = visits.groupBy(key).agg(F.max(_key(seq)).alias("_last"))
    return last.orderBy(F.desc("_last"), key).limit(RECENT).select(key, "_last.*")


def pasted(palettes: DataFrame, targets: DataFrame, source: str, key: str = "image_id") -> DataFrame:
    """``palettes(key, palette)`` with the palette of ``source`` copied to the targets; as they were if it has none."""
    own, target = unused(palettes, "copied", "target")
    copied = palettes.where(F.col(key) == source).agg(F.min("palette").alias(own))  # the least, if it has several
    marked = palettes.join(targets.select(key).distinct().withColumn(target, F.lit(True)), key, "left")
    out = marked.join(F.broadcast(copied), how="left")
    return out.withColumn("palette", F.when(F.col(target), F.coalesce(own, "palette")).otherwise(F.col("palette"))).drop(target, own)


def palettes_reset(modified: DataFrame, targets: DataFrame, key: str = "image_id") -> DataFrame:
    """The palettes that were changed, without those of the targets, which so show their own again."""
    return deleted(modified, targets, key)


def palettes_at(pictures: DataFrame, edits: DataFrame, key: str, picture: str, time: str = "ts", seq: str = "seq", slot: str = "slot", color: str = "rgb") -> DataFrame:
    """``picture, slot, color``: the colours set by the last of the ``edits(key, time, seq, slot, color)`` up to each picture's time.

    ``pictures(picture, key, time)`` are ids of their own. Of edits at one time the last by ``seq`` wins; an edit at a
    picture's very time counts. A slot that was not edited by then has no row, and neither has a picture without any.

    Times are cut into ranges. Each range starts with what the last edits before it have left of each slot, and inside a
    range a picture takes the latest of that and of the range's own edits: a key with a third of all edits is sorted in
    parts, by range and slot, and what is carried over is a row for each range and slot at most.
    """
    names = {key: "key", time: "time", seq: "seq", slot: "slot", color: "color"}
    own = edits.select(*[F.col(a).alias(b) for a, b in names.items()]).withColumn("picture", F.lit(None))
    asks = pictures.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(picture).alias("picture"))
    both = in_ranges(own.unionByName(asks, allowMissingColumns=True).withColumn("ask", F.col("picture").isNotNull()), ["time"], "range")
    own, asks = both.where(~F.col("ask")), both.where("ask").select("key", "range", "time", "picture")

    slots = own.select("key", "slot").distinct()
    left = own.groupBy("key", "range", "slot").agg(F.max_by("color", F.struct("time", "seq")).alias("color")).withColumn("kind", F.lit(1))
    opened = asks.select("key", "range").distinct().join(slots, "key").withColumn("kind", F.lit(0))
    carry = F.last("color", ignorenulls=True).over(Window.partitionBy("key", "slot").orderBy("range", "kind").rowsBetween(Window.unboundedPreceding, -1))
    carried = left.unionByName(opened, allowMissingColumns=True).withColumn("color", F.when(F.col("kind") == 0, carry)).where("kind = 0 and color is not null")

    rows = carried.select("key", "range", "slot", "color", "kind")
    rows = rows.unionByName(own.select("key", "range", "slot", "color", "time", "seq", F.lit(1).alias("kind")), allowMissingColumns=True)
    rows = rows.unionByName(asks.join(slots, "key").select("key", "range", "slot", "time", "picture", F.lit(2).alias("kind")), allowMissingColumns=True)
    latest = F.last("color", ignorenulls=True).over(Window.partitionBy("key", "range", "slot").orderBy(F.col("kind") != 0, "time", "kind", "seq"))
    seen = rows.withColumn("color", F.when(F.col("kind") == 2, latest)).where("kind = 2 and color is not null")
    return seen.select(F.col("picture").alias(picture), F.col("slot").alias(slot), F.col("color").alias(color))
