"""Toxic passages by maximum-scoring segments over token log-odds.

1. Tokens are runs of ASCII letters, digits and bytes from 0x80, lower-cased (A-Z). A token has its whole and its
   first 5, 6, 7 and 8 bytes as features, since inflected and compound words share a stem.
2. Over all documents, whole tokens are counted in ``2**BITS`` hashed cells, which gives the background of a
   Dirichlet prior (Monroe, Colaresi and Quinn, 2008). Labelled documents give the number of toxic and of clean
   documents by cell and, exactly, by every feature that ``LEAST_TOXIC`` toxic documents have.
3. A feature's score is its log-odds between toxic and clean less a multiple of its standard deviation and a
   drift. A token scores its best feature if that is above 0, else its cell's (negative) score, so that what is
   not surely toxic counts against a passage.
4. A linear-time scan (Ruzzo and Tompa, 1999) finds all maximal scoring segments of a text.
5. Segment scores become comparable over text lengths by extreme-value statistics: with lambda the positive root
   of E[exp(lambda s)] = 1 over clean texts and a location fitted to them, a segment of score S in n tokens has
   log-significance lambda S - ln n - mu. Segments beyond ``SIGNIFICANT`` are passages.
6. The largest significance and the summed significance of all passages go through a logistic calibration that
   labelled documents kept out of the counts fit.

Labels are learned from a bounded sample: the ``most_labels`` rows with the smallest hashes. Everything else
covers all documents. Scores depend on the text alone.

Edge cases: null and empty texts have no tokens and get the calibration's score for no passage; null labels and
labels without a document teach nothing; without labels of both classes every score is 0; several labels of one
document count as toxic if any is; rows that repeat a doc_id are scored as rows of their own; a null doc_id is
not held out; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, blocks, span_hashes, text_bytes

BITS, STEMS = 20, (5, 6, 7, 8)
MOST_LABELS = 200_000
PRIOR, LEAST_PRIOR, DEVIATIONS, DRIFT, FLOOR, CEILING = 2000.0, 0.5, 2.5, 0.2, -1.0, 8.0
LEAST_TOXIC = 3
SIGNIFICANT = 3.0
#: Added to a text's largest significance, so that 0 means that no token counts for a passage.
SHIFT = 20.0
#: Where E[exp(lambda s)] is taken, to find its root.
RATES = np.geomspace(0.05, 3.0, 24)

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and features (kinds by tokens, 0 for none) of all tokens, and each document's first token."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _TOKEN[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    body = solid[1:-1]
    starts = np.flatnonzero(body & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(body & (~solid[2:] | first[1:])) + 1
    low = LOWER[data]
    feats = np.zeros((1 + len(STEMS), len(starts)), np.uint64)
    feats[0] = span_hashes(low, starts, ends)
    for k, n in enumerate(STEMS, 1):
        long = np.flatnonzero(ends - starts > n)
        feats[k, long] = span_hashes(low, starts[long], starts[long] + n) + np.uint64(n)
    return starts, ends, feats, np.searchsorted(starts, offs)


def _cells(whole: np.ndarray) -> np.ndarray:
    return (whole & np.uint64(2**BITS - 1)).astype(np.int64)


# ---- counts -------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's counts by cell: tokens of all texts, toxic and clean documents."""
    sums = np.zeros((3, 2**BITS), np.int64)
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        toxic = batch.column("toxic").fill_null(-1).to_numpy()
        for lo, hi in blocks(offs):
            _, _, feats, firsts = _tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            cells = _cells(feats[0])
            np.add.at(sums[0], cells, 1)
            for i in np.flatnonzero(toxic[lo:hi] >= 0):
                own = np.unique(cells[firsts[i] : firsts[i + 1]])
                sums[2 - toxic[lo + i], own] += 1
    at = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(s[at]) for s in sums)], names=["cell", "n_all", "n_toxic", "n_clean"])


def _documents_by_feature(known: np.ndarray | None):  # noqa: ANN202
    """Numbers of documents by feature: of all features, or of ``known`` ones (sorted), by their number then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        sums = np.zeros(0 if known is None else len(known), np.int64)
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for lo, hi in blocks(offs):
                _, _, feats, firsts = _tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for i in range(hi - lo):
                    own = np.unique(feats[:, firsts[i] : firsts[i + 1]])
                    if known is None:
                        parts.append(own[own > 0])
                    else:
                        at = np.searchsorted(known, own)
                        at[at == len(known)] = 0
                        sums[at[known[at] == own]] += 1
        if known is None:
            f, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
        else:
            at = np.flatnonzero(sums)
            f, n = known[at], sums[at]
        yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n)], names=["f", "n"])

    return run


@dataclass
class Model:
    """What scoring needs; the label bound bounds its size."""

    cells: np.ndarray
    features: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    location: float = 0.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    trained: bool = False

    def __post_init__(self) -> None:
        self.screen = np.zeros(2**BITS, bool)
        self.screen[_cells(self.features)] = True

    def values(self, feats: np.ndarray) -> np.ndarray:
        """The score of each token."""
        out = self.cells[_cells(feats[0])]
        if len(self.features):
            kind, token = np.nonzero(self.screen[_cells(feats)])
            f = feats[kind, token]
            at = np.searchsorted(self.features, f)
            at[at == len(self.features)] = 0
            hit = self.features[at] == f
            np.maximum.at(out, token[hit], self.scores[at[hit]])
        return out


def log_odds(n_toxic: np.ndarray, n_clean: np.ndarray, toxic_docs: float, clean_docs: float, prior: np.ndarray | float = 0.0) -> np.ndarray:
    """Log-odds of features under a Dirichlet prior, less ``DEVIATIONS`` of their standard deviation and the drift."""
    a, b = n_toxic + prior + LEAST_PRIOR, n_clean + prior + LEAST_PRIOR
    delta = np.log(a / (toxic_docs + prior + 1)) - np.log(b / (clean_docs + prior + 1))
    return np.clip(delta - DEVIATIONS * np.sqrt(1 / a + 1 / b) - DRIFT, FLOOR, CEILING).astype(np.float32)


# ---- segments -----------------------------------------------------------------------------------


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score) of a sequence, in one pass over its sign runs."""
    if not len(values) or not (values > 0).any():
        return []
    positive = values > 0
    runs = np.concatenate([[0], np.flatnonzero(positive[1:] != positive[:-1]) + 1])
    sums = np.add.reduceat(values.astype(float), runs).tolist()
    stops = [*runs[1:].tolist(), len(values)]
    kept: list[list] = []  # first, stop, sum before, sum after
    total = 0.0
    for start, stop, s, plus in zip(runs.tolist(), stops, sums, positive[runs].tolist()):
        if not plus:
            total += s
            continue
        new = [start, stop, total, total + s]
        total += s
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
            j -= 1
    return [(a, b, after - before) for a, b, before, after in kept]


def _features(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list, np.ndarray]]:
    """For each batch: number of tokens, largest significance and summed significance by document, the passages,
    and sums of exp(lambda s) by document at ``RATES``."""
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        feats, passages = np.zeros((batch.num_rows, 3)), [[] for _ in range(batch.num_rows)]
        moments = np.zeros((batch.num_rows, len(RATES)))
        for lo, hi in blocks(offs):
            starts, ends, tokens, firsts = _tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            value = model.values(tokens)
            if not model.trained:
                for k, rate in enumerate(RATES):
                    sums = np.concatenate([[0], np.cumsum(np.exp(rate * value.astype(float)))])
                    moments[lo:hi, k] = sums[firsts[1:]] - sums[firsts[:-1]]
            plus = np.concatenate([[0], np.cumsum(value > 0)])
            feats[lo:hi, 0] = np.diff(firsts)
            for i in np.flatnonzero(plus[firsts[1:]] > plus[firsts[:-1]]):
                a, b = firsts[i], firsts[i + 1]
                found = []
                floor = np.log(b - a) + model.location
                base = offs[lo + i] - offs[lo]
                for x, y, s in maximal_segments(value[a:b]):
                    z = model.rate * s - floor
                    feats[lo + i, 1] = max(feats[lo + i, 1], z + SHIFT, 0.01)
                    if z > SIGNIFICANT:
                        feats[lo + i, 2] += z
                        found.append({"start": int(starts[a + x] - base), "stop": int(ends[a + y - 1] - base), "significance": float(z)})
                passages[lo + i] = found
        yield batch, feats, passages, moments


def _design(feats: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(feats)), np.clip(feats[:, 1], 0, 60) / 10, np.log1p(feats[:, 2])], 1)


def _probability(model: Model, feats: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(feats) @ np.array(model.weights), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(x.shape[1]), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


# ---- the operator -------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    sc = docs.sparkSession.sparkContext
    clean = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = clean.withColumn("fold", F.pmod(order, F.lit(4)).cast("int")).orderBy(order, "doc_id").limit(most_labels)
    scratch = Scratch(docs.sparkSession)
    sample = scratch.table(sample, "labels")  # at most most_labels rows of three numbers, so it may be broadcast
    learn, held = sample.where("fold > 0").select("doc_id", "toxic"), sample.where("fold = 0").select("doc_id", "toxic")

    by_cell = docs.join(F.broadcast(learn), "doc_id", "left").select("text", "toxic").mapInArrow(_count, "cell int, n_all long, n_toxic long, n_clean long")
    by_cell = scratch.table(by_cell.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n_all", "n_toxic", "n_clean"))), "counts")
    total = by_cell.agg(F.sum("n_all")).first()[0] or 0
    sizes = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    table = by_cell.where("n_toxic + n_clean > 0").toArrow()  # at most 2**BITS rows, whatever the corpus
    cells = np.full(2**BITS, -DRIFT, np.float32)
    at, (n_all, n_toxic, n_clean) = table.column("cell").to_numpy(), (table.column(c).to_numpy() for c in ("n_all", "n_toxic", "n_clean"))
    toxic_docs, clean_docs = sizes.get(1, 0), sizes.get(0, 0)
    cells[at] = np.minimum(-DRIFT, log_odds(n_toxic, n_clean, toxic_docs, clean_docs, PRIOR * n_all / max(1, total)))
    model = Model(cells, np.zeros(0, np.uint64), np.zeros(0, np.float32))
    if toxic_docs and clean_docs:
        toxic_texts, clean_texts = (docs.join(F.broadcast(learn.where(f"toxic = {v}").select("doc_id")), "doc_id").select("text") for v in (1, 0))
        counted = toxic_texts.mapInArrow(_documents_by_feature(None), "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
        known = counted.where(F.col("n") >= LEAST_TOXIC).toArrow()  # bounded by the label sample
        f = known.column("f").to_numpy().view(np.uint64)
        by_value = np.argsort(f)
        f, n_toxic = f[by_value], known.column("n").to_numpy()[by_value]
        n_clean = np.zeros(len(f), np.int64)
        cast = sc.broadcast(f)

        def count_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _documents_by_feature(cast.value)(batches)

        if len(f):
            got = clean_texts.mapInArrow(count_clean, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
            n_clean[np.searchsorted(f, got.column("f").to_numpy().view(np.uint64))] = got.column("n").to_numpy()
        scores = log_odds(n_toxic, n_clean, toxic_docs, clean_docs)
        model = Model(cells, f[scores > 0], scores[scores > 0])
        model = _calibrate(model, docs.join(F.broadcast(held), "doc_id").select("text", "toxic"))
    scratch.drop()
    return model


def _measured(model: Model, held: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, features and exponential sums of ``held``, at most a quarter of the label bound."""
    cast = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, feats, _, moments in _features(cast.value, batches):
            sums = pa.FixedSizeListArray.from_arrays(pa.array(moments.reshape(-1)), len(RATES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(feats[:, k]) for k in range(3)), sums], names=["toxic", "n", "top", "total", "moments"])

    got = held.mapInArrow(run, "toxic int, n double, top double, total double, moments array<double>").toArrow().combine_chunks()
    moments = got.column("moments").combine_chunks().flatten().to_numpy().reshape(-1, len(RATES))
    return got.column("toxic").to_numpy().astype(float), np.stack([got.column(c).to_numpy() for c in ("n", "top", "total")], 1), moments


def _calibrate(model: Model, held: DataFrame) -> Model:
    """Lambda and the location from clean texts, and then, as passages depend on both, the logistic weights."""
    y, feats, moments = _measured(model, held)
    if not (0 < y.sum() < len(y)):
        return model
    mean = moments[y == 0].sum(0) / max(1.0, feats[y == 0, 0].sum())
    below = np.flatnonzero(mean < 1)
    model.rate = float(RATES[below[-1]]) if len(below) else float(RATES[0])
    y, feats, _ = _measured(model, held)
    quiet = (y == 0) & (feats[:, 1] > 0)
    if quiet.sum() >= 8:  # Gumbel of scale 1 after multiplying by lambda: the location from the median
        model.location = float(np.median(feats[quiet, 1] - SHIFT) + np.log(np.log(2)))
    y, feats, _ = _measured(model, held)
    model.weights, model.trained = tuple(_logistic(_design(feats), y)), True
    return model


_PASSAGES = "array<struct<start:long,stop:long,significance:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, score, passages``; passages are byte ranges of the UTF-8 text."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("significance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch, feats, passages, _ in _features(m, batches):
            p = _probability(m, feats) if m.trained else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, passages {_PASSAGES}")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_labels: int = MOST_LABELS) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; texts are not shuffled."""
    model = train(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))), most_labels)
    if not model.trained:
        return docs
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        for batch, feats, _, _ in _features(m, batches):
            yield batch.filter(pa.array(_probability(m, feats) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted, passages``."""
    docs = docs.select("doc_id", "text")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), most_labels)
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
