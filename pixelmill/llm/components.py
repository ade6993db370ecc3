"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join; no task holds a component. A round's result is written to the
shared folder, so a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``edges(a, b)`` to ``(node, comp)``, ``comp`` being the smallest node reachable; isolated nodes have no row.

    Works on any orderable column type. Null ends and loops are ignored; an empty table gives an empty one.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    cur = scratch.table(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    k, last = 0, None
    while True:
        # Large star: each node's larger neighbours go to its smallest neighbour (or itself).
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        k += 1
        new = scratch.table(small, f"{name}{k}")
        scratch_old, cur = f"{name}{k - 1}", new
        # A star forest has every node under one smaller node that is under none; its sums no longer change.
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(scratch_old)
        if state == last:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
        last = state
