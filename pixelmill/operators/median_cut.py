"""One palette for many pictures by median cut over colours and their counts.

All boxes are cut side by side, level by level: a box along its longest channel, where half of its pixels lie on either
side. Only the distinct colours, at most 2**24 however many the pictures, are gone over again for each level, and what
comes to the driver are the cuts of a level, one for each box.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.pixels import color_counts
from pixelmill.runtime import settled

CHANNELS = 3


def color_table(pictures: DataFrame, key: str, blob: Column) -> DataFrame:
    """``rgb, n`` over the triples of all blobs."""
    return color_counts(pictures, key, blob).groupBy("rgb").agg(F.sum("n").cast("long").alias("n"))


def _channel(rgb: Column, k: int) -> Column:
    return F.shiftright(rgb, 16 - 8 * k).bitwiseAND(255)


@dataclass
class Cuts:
    """The cuts of each level: by box the channel, and the largest value that goes to the first half (255: all of it)."""

    levels: list[list[tuple[int, int]]] = field(default_factory=list)

    def box(self, rgb: Column) -> Column:
        """The box of a colour: its index in the palette before empty boxes are left out."""
        flat = [(0, 255), *(c for cuts in self.levels for c in cuts)]  # a heap: the halves of node h are 2 * h and 2 * h + 1
        channels, values = (F.array(*[F.lit(c[i]) for c in flat]) for i in range(2))
        shown = F.array(*[_channel(rgb.cast("int"), k) for k in range(CHANNELS)])
        halve = lambda h, _: h * 2 + (F.get(shown, F.get(channels, h)) > F.get(values, h)).cast("int")
        steps = F.array(*[F.lit(k) for k in range(len(self.levels))]) if self.levels else F.array().cast("array<int>")
        return F.aggregate(steps, F.lit(1), halve) - 2 ** len(self.levels)


def cut_boxes(colors: DataFrame, levels: int) -> Cuts:
    """``colors(rgb, n)`` cut ``levels`` times, to at most ``2**levels`` boxes.

    Of channels of one length the first is cut, at the least value up to which half of the box lies, or the one before it
    if that is the largest. A box of one colour is left whole.
    """
    cuts = Cuts()
    for level in range(levels):
        boxed = colors.select(cuts.box(F.col("rgb")).alias("box"), "rgb", "n")
        values = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), _channel(F.col("rgb").cast("int"), k).alias("value")) for k in range(CHANNELS)]))
        bins = boxed.select("box", "n", values.alias("at")).groupBy("box", "at.channel", "at.value").agg(F.sum("n").alias("n"))  # 3 * 256 rows a box at most
        w = Window.partitionBy("box", "channel")
        up = F.sum("n").over(w.orderBy("value"))
        bins = bins.select("box", "channel", "value", up.alias("up"), F.sum("n").over(w).alias("all"), (F.max("value").over(w) - F.min("value").over(w)).alias("length"))
        # The least value with half of the box below or at it; the last value is no cut.
        half = F.min(F.when(F.col("up") * 2 >= F.col("all"), F.col("value")))
        before_last = F.max(F.when(F.col("up") < F.col("all"), F.col("value")))
        found = bins.groupBy("box", "channel", "length").agg(half.alias("half"), before_last.alias("before"))
        best = found.groupBy("box").agg(F.max_by(F.struct("channel", "half", "before"), F.struct("length", -F.col("channel"))).alias("at"), F.max("length").alias("length"))
        rows = {r["box"]: (r["at"]["channel"], 255 if r["length"] == 0 else min(r["at"]["half"], r["at"]["before"])) for r in best.collect()}  # a row a box
        cuts.levels.append([rows.get(b, (0, 255)) for b in range(2**level)])
    return cuts


def global_palette(colors: DataFrame, levels: int = 8) -> tuple[DataFrame, Cuts]:
    """``colors(rgb, n)`` to ``box, rgb, n, colors`` of each box that is not empty, its mean colour rounded half up; and the cuts."""
    colors = settled(colors.select(F.col("rgb").cast("int").alias("rgb"), F.col("n").cast("long").alias("n")))
    cuts = cut_boxes(colors, levels)
    means = [F.expr(f"(2 * sum(n * ((rgb >> {16 - 8 * k}) & 255)) + sum(n)) div (2 * sum(n))").alias(f"c{k}") for k in range(CHANNELS)]
    boxes = colors.withColumn("box", cuts.box(F.col("rgb"))).groupBy("box").agg(*means, F.sum("n").alias("n"), F.count("*").alias("colors"))
    return boxes.select("box", (F.col("c0") * 65536 + F.col("c1") * 256 + F.col("c2")).alias("rgb"), "n", "colors"), cuts
