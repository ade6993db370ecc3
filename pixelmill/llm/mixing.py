"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

A source's documents queue in a shuffled order (md5 of the doc_id), twice, as a document may be taken twice. A
copy's virtual finish time is the source's words up to its end divided by the source's target. All copies are
sorted by that time, over ranges of it, and the mix is cut where their running words use up the total budget: what
comes before is taken whole, and of the copy that the cut falls into the words before it (``mixed_documents`` takes
whole documents and leaves that copy out). As the targets add up to the budget, the cut lies near virtual time 1, and
a source's share is off its target by no more than the document that is under way.

Targets: the sources in code-point order, null last, weigh ``weights`` in turn and share ``budget`` times all
words; a target stops at ``repeats`` times its source's words, and the excess is shared anew by weight. Sorted by
words per weight, the sources that stop are a prefix, so window sums find the level at once.

Running sums go over ranges first - of hashes in a source, of virtual time in the mix - and within one range then,
so no source and no stretch of time is one task. Ranges of time behind the cut are not sorted.

Edge cases: null and empty texts have size 0 and are taken with 0 words; null sources are one source; rows that
repeat a doc_id are rows of their own; if there are no words at all, every target is 0; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, unused

WEIGHTS, BUDGET, REPEATS = (5, 2, 1), 1.5, 2
#: Rows of a hash range on average; running sums within a range are one task's sort.
RANGE_ROWS = 4096
#: Ranges whose words are added up in one group.
VOLUME = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``sizes(source, size)`` to ``source, source_rank, source_size, weight, target``."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w) for w in weights))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_rank", F.row_number().over(by_source) - 1)
    src = src.withColumn("weight", F.element_at(cycle, F.col("source_rank") % len(weights) + 1)).withColumn("most", F.col("source_size") * repeats)
    # In order of words per weight, sources stop at their most as long as the level without those before is above it.
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("most") / F.col("weight"), "source_rank")
    src = src.withColumn("words", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    src = src.withColumn("most_before", F.sum("most").over(order) - F.col("most")).withColumn("weight_before", F.sum("weight").over(order) - F.col("weight"))
    # The level without the first that does not stop; further on it only sinks, as too much is taken off.
    level = (F.col("words") * F.lit(float(budget)) - F.col("most_before")) / (F.col("all_weight") - F.col("weight_before"))
    src = src.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything))
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double"))
    return src.select("source", "source_rank", "source_size", "weight", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` and the key of the shuffled order."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "source", size.alias("size"), key.alias("shuffled"), F.xxhash64("text").alias("text_hash"))


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``docs(doc_id, text, source)`` to all copies: ``doc_id, text_hash, source, size, source_size, target, copy,
    virtual_finish, before, taken``; ``before`` is the mix's words before the copy, null far behind the cut."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sizes = scratch.table(sized(docs), "sizes")
    digits, n = 1, sizes.count()
    while 16**digits * RANGE_ROWS < n:
        digits += 1
    targets = cut(source_targets(sizes, weights, budget, repeats))
    ranged = sizes.withColumn("range", F.substring("shuffled", 1, digits))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range")) - F.col("words")
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), before.alias("words_before"))
    within = Window.partitionBy("source", "range").orderBy("shuffled", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = ranged.withColumn("end", F.sum("size").over(within))
    queued = queued.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("end", F.col("end") + F.col("words_before")).drop("s", "r", "words_before", "range")
    t = targets.select(F.col("source").alias("s"), "source_rank", "source_size", "target")
    queued = queued.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("end", F.col("end") + (F.col("copy") - 1) * F.col("source_size"))
    finish = F.when(F.col("target") > 0, F.col("end") / F.col("target")).otherwise(F.lit(0.0))
    per_unit = max(1, repeats * n // RANGE_ROWS)  # ranges of virtual time up to time 1
    copies = copies.withColumn("virtual_finish", finish).withColumn("range", F.least(F.floor(F.col("virtual_finish") * per_unit), F.lit(2 * per_unit)).cast("long"))
    copies = scratch.table(copies, "copies")

    total = targets.agg(F.floor(F.sum("source_size") * F.lit(float(budget)) + 0.5).cast("long").alias("total"))
    spans = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("volume", F.floor(F.col("range") / VOLUME))
    volumes = spans.groupBy("volume").agg(F.sum("words").alias("volume_words"))
    volumes = volumes.select("volume", (F.sum("volume_words").over(Window.orderBy("volume")) - F.col("volume_words")).alias("above"))  # a row for VOLUME * RANGE_ROWS copies
    inside = F.sum("words").over(Window.partitionBy("volume").orderBy("range")) - F.col("words")
    spans = spans.select("range", "volume", inside.alias("inside")).join(volumes, "volume")
    spans = spans.select("range", (F.col("inside") + F.col("above")).alias("words_before")).crossJoin(total)  # one row
    spans = spans.withColumn("behind", F.col("words_before") >= F.col("total"))
    mix = copies.join(spans, "range")
    salt = F.when(F.col("behind"), F.pmod(F.xxhash64("shuffled"), F.lit(1 << 16))).otherwise(0)
    order = Window.partitionBy("range", salt).orderBy("virtual_finish", "source_rank", "shuffled", "copy", "doc_id", "size", "text_hash")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    mix = mix.withColumn("before", F.when(~F.col("behind"), F.col("words_before") + running))
    taken = F.when(F.col("behind"), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.col("total") - F.col("before"))))
    mix = cut(mix.select("doc_id", "text_hash", "source", "size", "source_size", "target", "copy", "virtual_finish", "before", taken.cast("long").alias("taken")))
    scratch.drop()
    return mix


def _given(copies: DataFrame, used: Column) -> DataFrame:
    """By row: what it is given in all copies; rows that agree in all that the mix looks at are one here."""
    rows = F.count(F.when(F.col("copy") == 1, 1)).alias("rows")
    return copies.groupBy("source", "doc_id", "text_hash", "size").agg(F.sum(used).alias("given"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), rows)


def _repeated(df: DataFrame, n: str, portion: str, k: str) -> DataFrame:
    """``n`` rows for each row of ``df``, numbered from 0 as ``k``; arrays hold 4096 numbers at most."""
    some = df.where(F.col(n) > 0).withColumn(portion, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / 4096))))
    last = F.least(F.lit(4096).cast("long"), F.col(n) - F.col(portion) * 4096) - 1
    return some.withColumn(k, F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(k, F.col(k) + F.col(portion) * 4096)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``."""
    per = _given(mix_copies(docs, weights, budget, repeats), F.col("taken"))
    # Rows that agree share what they were given, the first ones a word more.
    each = _repeated(per, "rows", "portion", "k")
    share = F.floor(F.col("given") / F.col("rows")) + F.when(F.col("k") < F.col("given") % F.col("rows"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs`` with all their columns, as often as the mix takes each, as whole documents.

    Rows that agree in doc_id, text and source stand for each other: one of them comes as often as all are taken.
    """
    copies = mix_copies(docs, weights, budget, repeats)
    whole = ((F.col("taken") == F.col("size")) & (F.col("size") > 0)) | ((F.col("size") == 0) & (F.col("copy") == 1))
    names = unused(docs, "source", "doc", "hash", "times", "rows", "portion", "k")
    source, doc, text_hash, times, rows, portion, k = names
    per = _given(copies, whole.cast("long")).where("given > 0")
    per = per.select(F.col("source").alias(source), F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("given").alias(times), F.col("rows").alias(rows))
    same = docs["doc_id"].eqNullSafe(F.col(doc)) & docs["source"].eqNullSafe(F.col(source)) & (F.xxhash64(docs["text"]) == F.col(text_hash))
    found = docs.join(per, same)
    once = found.where(F.col(rows) > 1).dropDuplicates([source, doc, text_hash])
    return _repeated(found.where(F.col(rows) == 1).unionByName(once), times, portion, k).select(*[f"`{c}`" for c in docs.columns])
