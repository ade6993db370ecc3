"""Directory trees of any depth out of the paths of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.export import numbered


def _with_ancestors(parts: str) -> Column:
    """The directory itself and all above it, the root as an empty list."""
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))


def tree_sizes(entries: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """``directory, depth, own_files, files, size, first, last`` of each directory and of the root, which is ``''``.

    ``own_files`` lie in the directory itself, ``files`` and ``size`` count all below. ``first`` numbers directories so that
    each comes before what it holds, siblings by name, and ``last`` is the number of the last one below: a subtree is a
    range of numbers. Null paths and sizes count as the root's file and as 0.

    Files are summed up by their own directory first; only directories are then repeated for those above them, and these
    sums, too, are partial before they are shuffled, so that a root that holds everything is as many rows as tasks.
    """
    parts = F.split(F.coalesce(F.col(path), F.lit("")), "/")
    held = entries.select(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dir"), F.coalesce(F.col(size), F.lit(0)).alias("size"))
    own = held.groupBy("dir").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    spread = own.select("dir", "n", "size", F.explode(_with_ancestors("dir")).alias("above"))
    mine = F.when(F.col("dir") == F.col("above"), F.col("n")).otherwise(0)
    sums = spread.groupBy("above").agg(F.sum(mine).alias("own_files"), F.sum("n").alias("files"), F.sum("size").cast("long").alias("size"))
    below = sums.select(F.explode(_with_ancestors("above")).alias("above")).groupBy("above").agg((F.count("*") - 1).alias("below"))
    placed = numbered(sums.join(below, "above"), ["above"], name="first")
    return placed.select(F.array_join("above", "/").alias("directory"), F.size("above").cast("long").alias("depth"), "own_files", "files", "size", "first", (F.col("first") + F.col("below")).alias("last"))
