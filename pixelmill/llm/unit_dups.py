"""Substring dedup by hashing units: lines and the sentences inside them.

A line is what stands between line feeds, and a sentence a run in it without sentence end (``.``, ``!``, ``?`` and
their ideographic forms) together with the ends that follow it; so a passage that stands inside other text still
has its inner sentences as units. Units are compared with A-Z lower-cased and blanks collapsed. Every line counts
that is not empty then, so a repeated paragraph goes line by line whatever its length; sentences of fewer than
``min_words`` words stay where their line does. In scripts without blanks each character counts as a word. Units are
digested (128 bits) and counted globally; of equal ones the first by (doc_id, start) stays, and the others are
removed. Results keep the original character offsets; a line that goes is one span, whatever goes inside it.

A line of one sentence is one unit, as line and sentence are equal then. Partial counts go before the shuffle by
digest, and the join back to units is a plain equi-join that Spark splits where a unit is hot.

``passage_report`` and ``without_passages`` take finer units and longer spans: clauses (runs between sentence ends, commas,
colons and semicolons), compared without the marks around them, go only in a run of neighbours that repeat, of
``least_words`` words together. A chance repeat of a few words then stays, and a passage goes wherever it stands.

Edge cases: null and empty texts have no units; rows with one doc_id rank by their text's hash; rows that repeat doc_id
and text lose no unit to each other, and ``n_units`` counts those of all of them; null doc_ids rank last and are reported
with a null doc_id; a text may lose all its units; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, unused
from .screens import passes, screen

LINE = re.compile(r"[^\n]+")
UNIT = re.compile(r"[^.!?\u3002\uff01\uff1f\uff61\n]+[.!?\u3002\uff01\uff1f\uff61]*")
BLANKS = re.compile(r"[ \t\r\f\v]+")
#: Thai, Lao, Tibetan, Burmese, Khmer, kana and ideographs, which are written without blanks.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
MIN_WORDS = 6
#: Words of a repeated passage at least, and what ends a clause.
LEAST_WORDS = 20
CLAUSE_ENDS = ".!?,;:\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\uff61"
CLAUSE = re.compile(f"[^{CLAUSE_ENDS}\n]+[{CLAUSE_ENDS}]*")
_AZ = {c: c + 32 for c in range(0x41, 0x5B)}


def _enough(unit: str, min_words: int) -> bool:
    n = unit.count(" ") + 1
    return n >= min_words or (not unit.isascii() and n + len(UNSPACED.findall(unit)) - 1 >= min_words)


def text_units(text: str, min_words: int) -> Iterator[tuple[int, int, int, bool, bool, str]]:
    """Start, stop, start of the line, whether it is the line, whether it is a sentence of enough words, and the unit."""
    for line in LINE.finditer(text):
        at, end = line.span()
        whole = BLANKS.sub(" ", line[0]).strip(" ")
        if not whole:
            continue
        alone = False
        for m in UNIT.finditer(text, at, end):
            unit = BLANKS.sub(" ", m[0]).strip(" ")
            if _enough(unit, min_words):
                if unit == whole:
                    alone = True
                else:
                    yield m.start(), m.end(), at, False, True, unit
        yield at, end, at, True, alone, whole


def _units(min_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, stops, lines, whole, sentence, k1, k2 = ([] for _ in range(8))
            for row, text in enumerate(batch.column("text").to_pylist()):
                for start, stop, line, is_line, is_sentence, unit in text_units(text or "", min_words):
                    digest = hashlib.blake2b(unit.translate(_AZ).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append(row)
                    starts.append(start)
                    stops.append(stop)
                    lines.append(line)
                    whole.append(is_line)
                    sentence.append(is_sentence)
                    k1.append(int.from_bytes(digest[:8], "little", signed=True))
                    k2.append(int.from_bytes(digest[8:], "little", signed=True))
            at = pa.array(rows, pa.int64())
            flags = [pa.array(c, pa.bool_()) for c in (whole, sentence)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), *(pa.array(c, pa.int64()) for c in (starts, stops, lines)), *flags, *(pa.array(c, pa.int64()) for c in (k1, k2))],
                names=["doc_id", "text_hash", "start", "stop", "line", "whole", "sentence", "k1", "k2"],
            )

    return run


def repeated_units(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """All units of ``docs(doc_id, text)`` that may be removed, and those that are, with the document that keeps each."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    units = scratch.table(docs.mapInArrow(_units(min_words), "doc_id long, text_hash long, start long, stop long, line long, whole boolean, sentence boolean, k1 long, k2 long"), "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "start")
    groups = units.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    removed = units.join(groups, ["k1", "k2"]).where(~place.eqNullSafe(F.col("first")))
    return units, removed.select("doc_id", "text_hash", "start", "stop", "line", "whole", F.col("first.doc_id").alias("kept_in"))


def removed_spans(removed: DataFrame) -> DataFrame:
    """``doc_id, text_hash, spans``: the sorted spans that go; sentences of a line that goes are in its span."""
    span = F.struct("start", "stop")
    lines = removed.groupBy("doc_id", "text_hash", "line").agg(F.max(F.when(F.col("whole"), span)).alias("all"), F.collect_list(span).alias("some"))
    lines = lines.select("doc_id", "text_hash", F.when(F.col("all").isNull(), F.col("some")).otherwise(F.array("all")).alias("spans"))
    return lines.groupBy("doc_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # no more than a document's units


def unit_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_units, n_removed, removed_chars, removed`` (``start-stop,...``).

    ``n_units`` counts the sentences of enough words, and ``n_removed`` the spans: lines, and sentences of other lines.
    """
    scratch = Scratch(docs.sparkSession)
    units, removed = repeated_units(docs, scratch, min_words)
    per = units.groupBy("doc_id", "text_hash").agg(F.count_if("sentence").alias("n_units"))
    gone = removed_spans(removed).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    per = per.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_doc", "_hash")
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    per = per.withColumn("n_removed", F.size("spans").cast("long")).withColumn("chars", chars)
    per = cut(per).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    scratch.drop()
    ids = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = ids.join(per, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", *(F.coalesce(c, zero).alias(n) for c, n in (("n_units", "n_units"), ("n_removed", "n_removed"), ("chars", "removed_chars"))), F.coalesce(text, F.lit("")).alias("removed"))


def without_units(docs: DataFrame, min_words: int = MIN_WORDS, removed_as: str = "removed") -> DataFrame:
    """``docs`` with the removed units cut out of ``text`` and their original offsets in a column ``removed_as`` that ``docs`` lacks."""
    scratch = Scratch(docs.sparkSession)
    _, removed = repeated_units(docs.select("doc_id", "text"), scratch, min_words)
    spans = cut(removed_spans(removed))
    scratch.drop()
    return _without(docs, spans, removed_as)


def _without(docs: DataFrame, spans: DataFrame, removed_as: str) -> DataFrame:
    """``docs`` without the ``spans(doc_id, text_hash, spans)`` of their texts."""
    doc, text_hash = unused(docs, "doc", "hash")
    spans = spans.withColumnsRenamed({"doc_id": doc, "text_hash": text_hash, "spans": removed_as})
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left").drop(doc, text_hash)
    # What stays lies between the removed spans.
    stop = F.length("text").cast("long")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col(f"`{removed_as}`.stop"))
    starts = F.concat(F.col(f"`{removed_as}`.start"), F.array(stop))
    kept = F.array_join(F.zip_with(edges, starts, lambda a, b: F.substring("text", a.cast("int") + 1, (b - a).cast("int"))), "")
    return joined.withColumn("text", F.when(F.col(f"`{removed_as}`").isNull(), F.col("text")).otherwise(kept))


# ---- passages -----------------------------------------------------------------------------------


def text_clauses(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Start, stop, words and unit of each clause that is more than marks and blanks."""
    for m in CLAUSE.finditer(text):
        unit = BLANKS.sub(" ", m[0]).strip(" " + CLAUSE_ENDS)
        if unit:
            n = unit.count(" ") + 1
            yield m.start(), m.end(), n if unit.isascii() else max(n, n + len(UNSPACED.findall(unit)) - 1), unit


_CLAUSES = "doc_id long, text_hash long, k1 array<bigint>, k2 array<bigint>, start array<int>, stop array<int>, words array<int>"
_PLACES = "doc_id long, text_hash long, place long, start int, stop int, words int, k1 long, k2 long"


def _clauses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text with clauses, which it lists: digests of units, offsets and words."""
    for batch in batches:
        rows, ends, cols = [], [0], [[], [], []]
        digests: list[bytes] = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            for start, stop, n, unit in text_clauses(text or ""):
                digests.append(hashlib.blake2b(unit.translate(_AZ).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                for c, v in zip(cols, (start, stop, n)):
                    c.append(v)
            if len(digests) > ends[-1]:
                rows.append(row)
                ends.append(len(digests))
        keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        at, cuts = pa.array(rows, pa.int64()), pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(k))) for k in keys] + [pa.ListArray.from_arrays(cuts, pa.array(c, pa.int32())) for c in cols]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), *lists], names=[c.split()[0] for c in _CLAUSES.split(", ")])


def _clauses_that_pass(bitmap: Broadcast, least_words: int):  # noqa: ANN202
    """Clauses whose key the screen lets pass, a row each: of ``_CLAUSES`` to ``_PLACES``. Those in runs of fewer than ``least_words`` words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("k1").offsets.to_numpy())
            k1, k2, start, stop, words = (batch.column(c).flatten().to_numpy() for c in ("k1", "k2", "start", "stop", "words"))
            text = np.repeat(np.arange(batch.num_rows), size)
            place = np.arange(len(k1)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(passes(bitmap.value, k1))
            if len(at) and least_words:
                head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])]))
                long = np.add.reduceat(words[at].astype(np.int64), head) >= least_words
                at = at[np.repeat(long, np.diff(np.append(head, len(at))))]
            who = pa.array(text[at])
            cols = [batch.column("doc_id").take(who), batch.column("text_hash").take(who), *(pa.array(c[at]) for c in (place, start, stop, words, k1, k2))]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _PLACES.split(", ")])

    return run


def repeated_passages(docs: DataFrame, scratch: Scratch, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, n`` with the clauses of each text of ``docs(doc_id, text)`` that has some, and ``doc_id, text_hash,
    spans`` of the passages that go.

    Clauses are listed by text. Only those whose keys occur twice, and so in a row that they make a long run, are looked at
    further; for their keys alone the first places are then found, among all clauses. Keys pass screens of fixed size.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    units = scratch.table(docs.mapInArrow(_clauses, _CLAUSES), "units")
    twice = units.select(F.explode("k1").alias("k1")).groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select("k1")
    near = scratch.table(units.mapInArrow(_clauses_that_pass(sc.broadcast(screen(twice)), least_words), _PLACES), "near")
    asked = sc.broadcast(screen(near.select("k1")))
    where = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "start")
    groups = units.mapInArrow(_clauses_that_pass(asked, 0), _PLACES).groupBy("k1", "k2").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = near.join(groups, ["k1", "k2"]).where(~where.eqNullSafe(F.col("first")))
    clause = F.struct("place", "start", "stop", "words")
    per = later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(clause)).alias("clauses"))  # no more than a document's clauses
    runs = per.select("doc_id", "text_hash", F.posexplode("clauses").alias("k", "c"))
    runs = runs.groupBy("doc_id", "text_hash", (F.col("c.place") - F.col("k")).alias("run")).agg(F.min("c.start").alias("start"), F.max("c.stop").alias("stop"), F.sum("c.words").alias("words"))
    spans = runs.where(F.col("words") >= least_words).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).alias("spans"))
    return units.select("doc_id", "text_hash", F.size("k1").cast("long").alias("n")), spans


def passage_report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_units, n_removed, removed_chars, removed`` (``start-stop,...``): clauses, and the passages that go."""
    scratch = Scratch(docs.sparkSession)
    units, spans = repeated_passages(docs, scratch, least_words)
    per = units.groupBy("doc_id", "text_hash").agg(F.max("n").alias("n_units"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    as_other = {"doc_id": "_doc", "text_hash": "_hash"}
    per = cut(per.join(spans.withColumnsRenamed(as_other), same, "left").drop("_doc", "_hash")).withColumnsRenamed(as_other)
    scratch.drop()
    joined = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).join(per, same, "left")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    chars, zero = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]), F.lit(0).cast("long")
    columns = (("n_units", F.col("n_units")), ("n_removed", F.size("spans").cast("long")), ("removed_chars", chars))
    return joined.select("doc_id", *(F.coalesce(c, zero).alias(n) for n, c in columns), F.coalesce(text, F.lit("")).alias("removed"))


def without_passages(docs: DataFrame, least_words: int = LEAST_WORDS, removed_as: str = "removed") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and their original offsets in a column ``removed_as`` that ``docs`` lacks."""
    scratch = Scratch(docs.sparkSession)
    _, spans = repeated_passages(docs.select("doc_id", "text"), scratch, least_words)
    spans = cut(spans)
    scratch.drop()
    return _without(docs, spans, removed_as)
