"""Chains of cells as a relation: allocation tables, sector links and block lists, followed by pointer doubling.

``cells(disk, cell, next)`` has one row for each cell. A chain ends at a cell whose ``next`` is null or no cell of its disk.
Cells that only one other leads to, and that stand near it in the order of their disk, are first put together to runs,
block by block. Then round k joins what is known of all chains, their first 2**k runs, with the links that are 2**k
runs long, so that a chain of n runs takes log2(n) joins, all chains are followed at once, and no chain or disk has to
fit into a task. Where neighbours are never linked a run is a cell. Each round is written to the shared folder, so that a
plan reads one round and not all before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.runtime import settled, ship

#: Neighbouring cells among which runs are looked for at once.
BLOCK = 1 << 18


def links(cells: DataFrame) -> DataFrame:
    """``disk, cell, to`` where the next cell is one of the disk's."""
    there = cells.select("disk", F.col("cell").alias("next"))
    return cells.select("disk", "cell", "next").join(there, ["disk", "next"], "left_semi").select("disk", "cell", F.col("next").alias("to"))


def heads(cells: DataFrame) -> DataFrame:
    """``disk, cell`` of the cells that no other leads to."""
    return cells.select("disk", "cell").join(links(cells).select("disk", F.col("to").alias("cell")), ["disk", "cell"], "left_anti")


def _runs_of(block: pa.Table) -> pa.Table:
    n, own = block.num_rows, np.arange(block.num_rows)
    key, before = block["key"].to_numpy(), block["before"].fill_null(0).to_numpy()
    order = np.argsort(key)
    up = order[np.minimum(np.searchsorted(key, before, sorter=order), n - 1)]
    # Keys are hashes: what is not the cell meant counts as outside of the block.
    there = block.take(pa.array(up))
    inner = pc.fill_null(pc.and_(pc.equal(block["prev"], there["cell"]), pc.equal(block["disk"], there["disk"])), False).to_numpy()
    head, offset = np.where(inner, up, own), inner.astype(np.int64)
    for _ in range(n.bit_length()):
        if not inner[head].any():
            break
        offset += offset[head]
        head = head[head]
    length = np.zeros(n, np.int64)
    np.maximum.at(length, head, offset + 1)
    last = offset + 1 == length[head]
    to = block["next"].take(pa.array(own, mask=~last))
    out = {"disk": block["disk"], "run": block["cell"].take(pa.array(head)), "offset": offset, "cell": block["cell"], "start": block["start"], "last": last, "to": to}
    return pa.table(out).filter(pa.array(~inner[head]))  # the others are circles, which no start leads to


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order to their runs in blocks: first cell, place in the run, and where the run ends the next cell."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield from _runs_of(pa.Table.from_batches(kept)).to_batches()
            kept, n = [], 0
    if n:
        yield from _runs_of(pa.Table.from_batches(kept)).to_batches()


def runs(cells: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``disk, run, offset, cell, start, last, to`` of all cells but some closed circles; a run is known by its first cell.

    Runs begin at each of ``starts`` (``heads`` by default), where chains meet, and where the one cell that leads there is in
    another block. ``last`` cells have the next one in ``to``.
    """
    ship(cells.sparkSession)
    types = dict(cells.dtypes)
    yes, no, none = F.lit(True), F.lit(None).cast("boolean"), F.lit(None).cast(types["cell"])
    cells = cells.where("disk is not null and cell is not null")
    rows = cells.select("disk", "cell", yes.alias("here"), "next", none.alias("prev"), no.alias("start"))
    rows = rows.union(cells.where("next is not null").select("disk", "next", no, none, "cell", no))
    if starts is not None:
        rows = rows.union(starts.select("disk", "cell", no, none, none, yes))
    known = rows.groupBy("disk", "cell").agg(F.max("here").alias("here"), F.max("next").alias("next"), F.count("prev").alias("n"), F.min("prev").alias("prev"), F.max("start").alias("start"))
    start = F.col("n") == 0 if starts is None else F.coalesce("start", F.lit(False))
    known = known.where("here").select("disk", "cell", "next", start.alias("start"), F.when((F.col("n") == 1) & ~start, F.col("prev")).alias("prev"))
    keyed = known.select("*", F.xxhash64("disk", "cell").alias("key"), F.when(F.col("prev").isNotNull(), F.xxhash64("disk", "prev")).alias("before"))
    schema = f"disk {types['disk']}, run {types['cell']}, offset long, cell {types['cell']}, start boolean, last boolean, to {types['cell']}"
    return keyed.repartitionByRange("disk", "cell").sortWithinPartitions("disk", "cell").mapInArrow(_runs, schema)


def followed(cells: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``disk, start, position, cell, loops``: the cells that each of ``starts(disk, cell)`` leads to, ``heads`` by default.

    Chains may share cells, which then are in each of them. A chain that comes back to one of its cells stops there, and
    ``loops`` marks it. Starts that are no cell have no rows.
    """
    members = settled(runs(cells, starts))
    ends = members.where("last").select("disk", F.col("run").alias("cell"), (F.col("offset") + 1).alias("length"), F.col("to"))
    own = settled(ends.join(ends.select("disk", F.col("cell").alias("to")), ["disk", "to"], "left_semi").select("disk", "cell", "to", "length"))
    walk = settled(members.where("start").select("disk", F.col("cell").alias("start"), F.lit(0).cast("long").alias("position"), "cell"))
    jump, n = own, walk.count()
    while n:
        more = walk.join(jump, ["disk", "cell"]).select("disk", "start", (F.col("position") + F.col("length")).alias("position"), F.col("to").alias("cell"))
        longer = settled(walk.unionByName(more).groupBy("disk", "start", "cell").agg(F.min("position").alias("position")))
        m = longer.count()
        if m == n:
            break
        walk, n = longer, m
        onward = jump.select("disk", F.col("cell").alias("to"), F.col("to").alias("beyond"), F.col("length").alias("further"))
        jump = settled(jump.join(onward, ["disk", "to"]).select("disk", "cell", F.col("beyond").alias("to"), (F.col("length") + F.col("further")).alias("length")))
    at = walk.groupBy("disk", "start").agg(F.max(F.struct("position", "cell")).alias("at")).select("disk", "start", F.col("at.cell").alias("cell"))
    loops = at.join(own, ["disk", "cell"], "left").select("disk", "start", F.col("to").isNotNull().alias("loops"))
    walk = walk.join(loops, ["disk", "start"]).select("disk", "start", "position", F.col("cell").alias("run"), "loops")
    found = walk.join(members.select("disk", "run", "offset", "cell"), ["disk", "run"])
    return found.select("disk", "start", (F.col("position") + F.col("offset")).alias("position"), "cell", "loops")


def unreached(cells: DataFrame, chains: DataFrame) -> DataFrame:
    """``disk, cell`` of the cells in no chain. With all heads followed these are closed circles."""
    return cells.select("disk", "cell").join(chains.select("disk", "cell"), ["disk", "cell"], "left_anti")
