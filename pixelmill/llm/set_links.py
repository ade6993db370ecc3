"""Exact links between sets that share a band of their sketches, and the components of those links.

Linked are sets with ``100 * |A and B| >= percent * |A or B|``, which is ``|A xor B| <= (|A| + |B|) * c`` with
``c = (100 - percent) / (100 + percent)``. A pair is looked at if it shares a band, and decided over the full sets:

1. Members of a bucket of at most ``SMALL`` sets meet each other, those of a larger one meet two pivots of it. One
   pivot is the set that meets the most others in such buckets, as a text does that many copies were made from. Bitmaps (below) rule
   pairs out before their texts are fetched.
2. Links make components. Where a bucket then still holds several, members outside its largest component meet those of
   other components, again behind their bitmaps, if there are at most ``MEDIUM`` of them: work that grows as the bucket,
   and rows only for pairs that stay. Where there are more, each member is described by its difference ``D`` to the
   bucket's first pivot. Sets of different components are linked only if
   ``|Da and Db| >= k = (|Da| + |Db| - c * (|A| + |B|)) / 2``, and then ``k >= 1``: with ``k <= 0`` both would be
   linked with the pivot. So differences are joined on their rarest elements (prefix filter): as ``|B| <= |A| / p``
   and ``|Db| >= |Da| - c * (|A| + |B|)``, ``k`` is at least ``|Da| - |A| * (100 - percent) / percent``, and of any
   linked pair one of the first ``|Da| - k + 1`` elements is shared. Elements that stand in one component only come
   first in that order and join nothing.

No pair is lost but those that share no band, and no bucket is capped or expanded into all its pairs.

A set's bitmap is 512 bits, each telling whether an odd number of elements falls there. Two of them differ in at most
``|A xor B|`` bits, so that more of them than a link allows rule it out for certain. Unrelated sets differ in about 256,
which tells of sizes up to some 1000 each; sets of ``LONG`` elements have a second bitmap of 2048 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix
from .components import components

#: A column of texts to (position, sorted distinct hashes) of each.
Sets = Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]]
#: Members of a bucket that all meet each other, and members outside its largest component that meet the other components.
SMALL, MEDIUM = 12, 2048
#: Bands that one exchange moves at most.
ROUND = 8
#: Rows (band, set) that are dealt, packed or sorted at once.
GROUP = 1 << 20
#: Bands that are dealt by member.
COMMON = 10_000
#: Elements from which a set has the wide bitmap.
LONG = 800
#: Sets whose bitmaps are made at once.
PACKED = 1 << 10
#: A set's size, its bitmap, and the wide one or null.
BITS = [f"b{i}" for i in range(8)]
SIGNS = ["size", *BITS, "wide"]
#: The bitmap of a set of step 2, made from its text.
ODD = [f"odd{i}" for i in range(8)]
SIGNS_SCHEMA = ", ".join(f"{name} {'array<long>' if name == 'wide' else 'long'}" for name in SIGNS)


def _odd_bits(hashes: np.ndarray, cuts: np.ndarray, bits: int) -> np.ndarray:
    """For each set ``hashes[cuts[i]:cuts[i + 1]]`` of distinct elements ``2**bits`` bits in words: where an odd number of them falls."""
    n, size = len(cuts) - 1, np.diff(cuts)
    out = np.zeros((n, 1 << (bits - 3)), np.uint8)
    for lo in range(0, n, PACKED):
        hi = min(n, lo + PACKED)
        place = hashes[cuts[lo] : cuts[hi]] >> np.uint64(64 - bits)
        place |= np.repeat(np.arange(hi - lo, dtype=np.uint64) << np.uint64(bits), size[lo:hi])
        many = np.bincount(place.view(np.int64), minlength=(hi - lo) << bits).astype(np.uint8)
        many &= 1
        out[lo:hi] = np.packbits(many, bitorder="little").reshape(hi - lo, -1)
    return out.view(np.int64)


def signs(hashes: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """The columns ``SIGNS`` of the sets ``hashes[cuts[i]:cuts[i + 1]]``, each sorted and without repeats."""
    size = np.diff(cuts)
    long = size >= LONG
    wide = _odd_bits(hashes[np.repeat(long, size)], np.concatenate([[0], np.cumsum(size[long])]), 11)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(wide) + 1, dtype=np.int32) * 32), pa.array(wide.reshape(-1)))
    wide = lists.take(pa.array(np.cumsum(long) - 1, mask=~long))
    return [pa.array(size), *[pa.array(x) for x in np.ascontiguousarray(_odd_bits(hashes, cuts, 9).T)], wide]


# ---- buckets ------------------------------------------------------------------------------------


_DEALT = "g long, bands binary, cs binary"


def _band_rows(column: pa.Array) -> np.ndarray:
    """Packed bands, the same number of each set, as rows."""
    offs, data = (np.frombuffer(b, t) for b, t in zip(column.buffers()[1:], (np.int32, np.uint8)))
    lo, hi = offs[column.offset], offs[column.offset + len(column)]
    return data[lo:hi].view(np.int64).reshape(len(column), -1)


def _single_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(_band_rows(batch.column("bands")).reshape(-1))], names=["band"])


def _deal(common: np.ndarray, bits: int):  # noqa: ANN202
    """Sets' bands and their ids by group ``g``: the first ``bits`` bits of the band or, if it is common, of the id's hash."""

    def flush(kept: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bands, c = np.concatenate([b for b, _ in kept]), np.concatenate([c for _, c in kept])
        c, once = np.unique(c, return_index=True)
        width = bands.shape[1]
        bands, c = bands[once].reshape(-1), np.repeat(c, width)
        g = bands.view(np.uint64) >> np.uint64(64 - bits)
        if len(common):
            at = np.minimum(np.searchsorted(common, bands), len(common) - 1)
            hot = np.flatnonzero(common[at] == bands)
            g[hot] = mix(c[hot].view(np.uint64)) >> np.uint64(64 - bits)
        order = np.argsort(g, kind="stable")
        g, bands, c = g[order], bands[order], c[order]
        cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        ends = np.append(cuts, len(g)) * 8
        blobs = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(x)]).cast(pa.binary()) for x in (bands, c)]
        return pa.RecordBatch.from_arrays([pa.array(g[cuts].view(np.int64)), *blobs], names=["g", "bands", "cs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append((_band_rows(batch.column("bands")), batch.column("c").to_numpy()))
                n += kept[-1][0].size
            if n >= GROUP:
                yield flush(kept)
                kept, n = [], 0
        if kept:
            yield flush(kept)

    return run


def _shared(common: np.ndarray):  # noqa: ANN202
    """Rows of ``_deal`` sorted by group to rows ``a, b, n``: pairs of sets of small buckets (n 0), the band and a set of
    larger buckets of n sets, and those of common bands (n -1), whose sets are in several groups."""

    def bucket(bands: list[bytes], cs: list[bytes]) -> pa.RecordBatch:
        band, c = (np.frombuffer(b"".join(x), np.int64) for x in (bands, cs))
        order = np.argsort(band)
        band, c = band[order], c[order]
        hot = np.isin(band, common)
        same = np.append(False, band[1:] == band[:-1])
        keep = same | np.append(same[1:], False) | hot
        band, c, hot = band[keep], c[keep], hot[keep]
        order = np.lexsort((c, band))
        band, c, hot = band[order], c[order], hot[order]
        once = np.append(True, (band[1:] != band[:-1]) | (c[1:] != c[:-1]))[: len(band)]
        band, c, hot = band[once], c[once], hot[once]
        first = np.flatnonzero(np.append(True, band[1:] != band[:-1])[: len(band)])
        many = np.diff(np.append(first, len(band)))
        n = np.repeat(many, many)
        small = (n <= SMALL) & ~hot
        found_a, found_b, found_n = [], [], []
        for d in range(1, SMALL):
            at = np.flatnonzero(small[: len(band) - d] & (band[: len(band) - d] == band[d:])) if len(band) > d else first[:0]
            if not len(at):
                break
            found_a.append(c[at + d])
            found_b.append(c[at])
            found_n.append(np.zeros(len(at), np.int32))
        rest = ~small
        cols = [[*found_a, band[rest]], [*found_b, c[rest]], [*found_n, np.where(hot, -1, n)[rest].astype(np.int32)]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bands, cs = None, [], []
        for batch in batches:
            for g, b, c in zip(batch.column("g").to_pylist(), batch.column("bands"), batch.column("cs")):
                if g != group and bands:
                    yield bucket(bands, cs)
                    bands, cs = [], []
                group = g
                bands.append(b.as_py())
                cs.append(c.as_py())
        if bands:
            yield bucket(bands, cs)

    return run


def _buckets(nodes: DataFrame, n_bands: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``nodes(c, bands)`` to the pairs ``c, p`` of small buckets, and ``band, c, n`` where a band has ``n > SMALL`` sets.

    Bands are dealt in groups of about ``GROUP`` rows, packed as arrays of numbers, in an exchange for every ``ROUND``
    bands, so that no more of them are on disk at once; pairs of small buckets are made where a group is. The most common
    bands, as a sample shows them, are dealt by ``c`` instead, and count as larger. There are at most ``COMMON`` of these;
    every other band holds a smaller part of the rows.
    """
    sample = nodes.sample(0.01, seed=1).select("bands").mapInArrow(_single_bands, "band long").groupBy("band").count()
    common = sample.where("count >= 20").orderBy(F.desc("count"), "band").limit(COMMON).select("band").toArrow()
    common = np.sort(common.column("band").to_numpy())
    nodes = nodes.select("c", "bands")
    rounds = max(1, -(-n_bands // ROUND))
    step, parts = -(-n_bands // rounds), []
    bits = max(6, (nodes.count() * step // GROUP).bit_length())
    for r in range(rounds):
        own = nodes.select("c", F.substring("bands", 8 * r * step + 1, 8 * step).alias("bands"))
        dealt = own.mapInArrow(_deal(common, bits), _DEALT).repartition("g").sortWithinPartitions("g")
        parts.append(scratch.table(dealt.mapInArrow(_shared(common), "a long, b long, n int"), f"links_met{r}", dictionary=False))
    met = reduce(DataFrame.unionByName, parts)
    pairs = scratch.table(met.where("n = 0").select(F.col("a").alias("c"), F.col("b").alias("p")).distinct(), "links_small", dictionary=False)
    large = met.where("n <> 0").select(F.col("a").alias("band"), F.col("b").alias("c"), F.col("n").cast("long").alias("n"))
    counts = large.where("n < 0").groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    large = large.where("n > 0").unionByName(large.where("n < 0").drop("n").join(counts, "band"))
    large = scratch.table(large, "links_large")
    for r in range(rounds):
        scratch.drop(f"links_met{r}")
    return pairs, large


# ---- pairs --------------------------------------------------------------------------------------


def _set_pairs(sets: Sets, batch: pa.RecordBatch, kept: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair both sets, and which elements of the pivot's the other has; ``kept`` holds the last pivot's set."""
    pivots = batch.column("p").to_numpy()
    new = np.append(not kept or kept[0][0] != pivots[0], pivots[1:] != pivots[:-1]) if len(pivots) else np.zeros(0, bool)
    fresh = sets(batch.column("pivot_text").filter(pa.array(new)))
    for i, s in sets(batch.column("text")):
        if new[i]:
            kept[:] = [(pivots[i], next(fresh)[1])]
        pivot = kept[0][1]
        at = np.searchsorted(s, pivot)
        at[at == len(s)] = 0
        yield s, pivot, s[at] == pivot if len(s) else np.zeros(len(pivot), bool)


def _verify(sets: Sets):  # noqa: ANN202
    """Pairs with both texts to pairs with the sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            sizes = [(np.count_nonzero(both), len(s) + len(p)) for s, p, both in _set_pairs(sets, batch, kept)]
            inter, total = np.array(sizes, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("p"), pa.array(inter), pa.array(total - inter)], names=["c", "p", "n_both", "n_union"])

    return run


def _differ(sets: Sets):  # noqa: ANN202
    """Pairs with both texts to the first one's size and parity, and the elements in which they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            odd = np.zeros((batch.num_rows, 8), np.uint64)
            diffs = [np.zeros(0, np.uint64)]
            for i, (s, p, both) in enumerate(_set_pairs(sets, batch, kept)):
                size[i] = len(s)
                at = s >> np.uint64(55)
                np.bitwise_xor.at(odd[i], (at >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), at & np.uint64(63)))
                diffs.append(np.concatenate([np.setdiff1d(s, p, assume_unique=True), p[~both]]))
            ends = np.cumsum([len(x) for x in diffs]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(diffs).view(np.int64)))
            words = [pa.array(x) for x in np.ascontiguousarray(odd.T).view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("p"), pa.array(size), *words, lists], names=["c", "p", "n_shingles", *ODD, "diff"])

    return run


def _with_texts(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """``pairs(c, p)`` with both texts; merged by pivot, so that a task reads a pivot's pairs one after the other."""
    texts = described.select(F.col("c").alias("k"), F.col("text").alias("t")).hint("merge")
    both = pairs.join(texts, F.col("c") == F.col("k")).select("c", "p", F.col("t").alias("text"))
    return both.join(texts, F.col("p") == F.col("k")).select("c", "p", "text", F.col("t").alias("pivot_text"))


def _verified(pairs: DataFrame, described: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The edges ``a, b`` of those pairs that are linked."""
    exact = _with_texts(pairs, described).mapInArrow(_verify(sets), "c long, p long, n_both long, n_union long")
    return exact.where(F.col("n_both") * 100 >= F.col("n_union") * percent).select(F.col("c").alias("a"), F.col("p").alias("b"))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether the sizes and bitmaps of two rows leave a link possible."""
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    most = (a + b) * (100 - percent)
    differ = sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in BITS[1:]), F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))))
    wide = F.aggregate(F.zip_with(f"{x}.wide", f"{y}.wide", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)
    sizes = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    return sizes & (differ * (100 + percent) <= most) & F.coalesce(wide * (100 + percent) <= most, F.lit(True))


def _ordered(x: str = "x.c", y: str = "y.c") -> list[Column]:
    return [F.greatest(x, y).alias("c"), F.least(x, y).alias("p")]


def _within(members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``c, p`` of members of a band that are in different components and may be linked.

    One of them is not in the band's largest component ``major``: few rows, which wait for all others to pass.
    """
    x, y = members.alias("x"), members.where("comp <> major").alias("y")
    other = (F.col("x.comp") == F.col("x.major")) | (F.col("x.comp") < F.col("y.comp"))
    return x.join(y, (F.col("x.band") == F.col("y.band")) & other & _may_link("x", "y", percent)).select(*_ordered())


def _first_pairs(small: DataFrame, signed: DataFrame, pivots: DataFrame, signs_of: DataFrame, percent: int) -> DataFrame:
    """The pairs ``c, p`` of small buckets, and of each member with the pivots of larger ones, where a link is possible."""
    larger = signed.join(pivots, "band").select("c", F.explode(F.array("p0", "p1")).alias("p")).where("c <> p")
    pairs = small.unionByName(larger.select(*_ordered("c", "p"))).distinct().alias("s")
    x, y = (signs_of.hint("shuffle_hash").alias(k) for k in "xy")
    met = pairs.join(x, F.col("s.c") == F.col("x.c")).join(y, F.col("s.p") == F.col("y.c"))
    return met.where(_may_link("x", "y", percent)).select("s.c", "s.p")


def _far_pairs(members: DataFrame, described: DataFrame, sets: Sets, percent: int, scratch: Scratch) -> DataFrame:
    """``members(p, c, comp)`` of large buckets' pivots to pairs ``c, p`` of different components that may be linked."""
    diffs = _with_texts(members.where("c <> p").select("c", "p"), described).mapInArrow(_differ(sets), f"c long, p long, n_shingles long, {', '.join(f'{o} long' for o in ODD)}, diff array<long>")
    diffs = scratch.table(diffs.join(members, ["c", "p"]).withColumn("n_diff", F.size("diff").cast("long")), "links_diffs")
    elements = diffs.select("p", "c", "comp", F.explode("diff").alias("e"))
    common = elements.groupBy("p", "e").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("p", "e", "df")
    matchable = elements.join(common, ["p", "e"])
    # The elements of one difference, rarest first; those that join nothing count as the first of them.
    listed = matchable.groupBy("p", "c").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es")).join(diffs.drop("diff"), ["p", "c"])
    listed = listed.withColumn("m", F.size("es").cast("long"))
    k = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("n_diff") * percent - F.col("n_shingles") * (100 - percent)) / percent))
    prefix = F.slice("es", F.lit(1), F.greatest(F.lit(0).cast("long"), F.col("m") - k + 1).cast("int"))
    keys = scratch.table(listed.where(k <= F.col("m")).select("p", "c", "comp", "n_shingles", "n_diff", "m", *ODD, F.explode(prefix).alias("key")).withColumn("e", F.col("key.e")).drop("key"), "links_keys")
    x, y = keys.alias("x"), keys.alias("y")
    a, b = F.col("x.n_shingles"), F.col("y.n_shingles")
    sizes = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    twice_k = (F.col("x.n_diff") + F.col("y.n_diff")) * (100 + percent) - (a + b) * (100 - percent)
    enough = F.least("x.m", "y.m") * (2 * (100 + percent)) >= twice_k
    differ = sum((F.bit_count(F.col(f"x.{o}").bitwiseXOR(F.col(f"y.{o}"))) for o in ODD[1:]), F.bit_count(F.col("x.odd0").bitwiseXOR(F.col("y.odd0"))))
    enough = enough & (differ * (100 + percent) <= (a + b) * (100 - percent))
    joined = x.join(y, (F.col("x.p") == F.col("y.p")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.comp") < F.col("y.comp")) & sizes & enough)
    return joined.select(*_ordered()).distinct()


def _joined(comp: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The components ``comp(node, comp)`` with the links ``edges(a, b)`` besides: rounds over components, not over nodes."""
    for end in ("a", "b"):
        own = comp.select(F.col("node").alias(end), F.col("comp").alias("own"))
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    more = scratch.table(components(edges, scratch, "last"), "links_last").select("node", F.col("comp").alias("least"))
    old = comp.join(more.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"))
    return old.unionByName(more.join(comp, "node", "left_anti").select("node", F.col("least").alias("comp")))


def set_components(nodes: DataFrame, describe: Callable[[DataFrame], DataFrame], sets: Sets, percent: int, n_bands: int, scratch: Scratch, sketched: str) -> DataFrame:
    """``nodes(c, bands, *SIGNS)``, a row or more for each set of ``n_bands`` bands, to ``(node, comp)`` of all sets with links.

    ``nodes`` reads the scratch table ``sketched``, which is dropped once bands and bitmaps have been taken from it.

    ``describe`` gives ``c, text`` for the sets of a table ``c``; ``sets`` are the sets of such texts.
    """
    small, large = _buckets(nodes, n_bands, scratch)
    weights = large.groupBy("c").agg(F.sum("n").alias("weight"))
    met = small.select("c").union(small.select(F.col("p").alias("c"))).union(large.select("c")).distinct()
    signs_of = scratch.table(nodes.select("c", *SIGNS).join(met.hint("shuffle_hash"), "c").dropDuplicates(["c"]), "links_signs", dictionary=False)
    scratch.drop(sketched)
    pivots = large.join(weights, "c").groupBy("band").agg(F.max(F.struct("weight", "c")).alias("p0"), F.min("c").alias("p1"))
    pivots = scratch.table(pivots.select("band", F.col("p0.c").alias("p0"), "p1"), "links_pivots")

    def needed(pairs: DataFrame) -> DataFrame:
        return pairs.select("c").union(pairs.select("p")).distinct()

    pairs = scratch.table(_first_pairs(small, large, pivots, signs_of, percent), "links_pairs", dictionary=False)
    described = scratch.table(describe(needed(pairs)), "links_described")
    comp = scratch.table(components(_verified(pairs, described, sets, percent), scratch, "first"), "comp")

    # Larger buckets that still hold several components.
    own = F.coalesce("comp", "c").alias("comp")
    at = large.join(comp.withColumnRenamed("node", "c"), "c", "left").select("band", "c", own)
    several = at.groupBy("band", "comp").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), (F.sum("k") - F.max("k")).alias("others"))
    open_ = scratch.table(at.join(several.where("others > 0"), "band").join(signs_of, "c"), "links_open", dictionary=False)
    rest = _within(open_.where(F.col("others") <= MEDIUM), percent).distinct()
    members = open_.where(F.col("others") > MEDIUM).join(pivots.select("band", F.col("p0").alias("p")), "band").select("p", "c", "comp").distinct()
    members = scratch.table(members, "links_members")
    if not members.isEmpty():
        described = scratch.table(describe(needed(members)), "links_described2")
        rest = rest.unionByName(_far_pairs(members, described, sets, percent, scratch)).distinct()
    rest = scratch.table(rest.join(pairs, ["c", "p"], "left_anti"), "links_rest")
    if not rest.isEmpty():
        described = scratch.table(describe(needed(rest)), "links_described3")
        more = scratch.table(_verified(rest, described, sets, percent), "links_more")
        if not more.isEmpty():
            comp = scratch.table(_joined(comp, more, scratch), "comp_last")
    for name in [name for name in scratch.names if name.startswith("links_")]:
        scratch.drop(name)
    return comp
