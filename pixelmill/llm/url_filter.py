"""URL filter: host and path rules, and a character language-model ratio for what no rule decides.

Two variable-order Markov models over the URL's characters, one of URLs that rules accept and one of URLs that
rules reject, are smoothed by Witten-Bell interpolation from order ``ORDER`` down to a uniform one. A URL's score
is the difference of its log-likelihoods divided by its length. The cut-off is calibrated on rule-decided URLs
that the counts leave out: it is the score with the best balanced accuracy, found on a histogram of all of them.

Counts cover every rule-decided URL. Characters are folded to ``SYMBOLS`` classes, so the models have at most
``SYMBOLS ** (ORDER + 1)`` cells whatever the corpus, and may be collected and broadcast.

Edge cases: a null URL or one without ``://`` has an empty host and path, no rule, and the method's verdict (an
empty URL scores 0); without decided URLs of both classes every score is 0 and the method allows; rows that
repeat a page_id are judged alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_bytes

ORDER, SYMBOLS = 3, 42
BINS = 4096
#: (host, path, verdict); a rule fits its host and all subdomains if the path starts with its path.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

_FOLD = np.full(256, 1, np.int64)  # 0 stands before the URL, 1 for all other characters
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789/.-_"):
    _FOLD[ord(_c)] = _i + 2
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _FOLD[_c + 32]
_CELLS = SYMBOLS ** (ORDER + 1)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_verdicts(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later, longer rules go first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


# ---- the models ---------------------------------------------------------------------------------


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each character with the ``ORDER`` symbols before it, and the ``len + 1`` offsets of the URLs."""
    data, offs = text_bytes(column)
    sym = _FOLD[data]
    cell = sym.copy()
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    for k in range(1, ORDER + 1):
        back = np.zeros(len(data), np.int64)
        back[k:] = sym[: max(0, len(sym) - k)]
        cell += np.where(place >= k, back, 0) * SYMBOLS**k
    return cell, offs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, _CELLS), np.int32)
    for batch in batches:
        cell, offs = _grams(batch.column("url"))
        good = np.repeat(batch.column("accepted").to_numpy(zero_copy_only=False).astype(bool), np.diff(offs))
        np.add.at(sums[1], cell[good], 1)
        np.add.at(sums[0], cell[~good], 1)
    at = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[1, at].astype(np.int64)), pa.array(sums[0, at].astype(np.int64))], names=["cell", "n_accepted", "n_rejected"])


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Log-probability of each cell's last symbol after the symbols before it, from counts of the highest order.

    Witten-Bell: a context of n characters and t distinct followers trusts itself by n / (n + t).
    """
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        c = counts.reshape(-1, SYMBOLS**order, SYMBOLS).sum(axis=0).astype(float)
        n, t = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (c.shape[0] // max(1, p.size // SYMBOLS), 1))
        p = np.where(n + t > 0, (c + t * lower) / np.maximum(n + t, 1), lower)
    return np.log(p).reshape(-1)


def _scores(urls: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """``urls`` with the length-normalised log-likelihood difference of ``url`` as ``llr``."""
    cast = urls.sparkSession.sparkContext.broadcast(ratio)
    names = urls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cast.value
        for batch in batches:
            if table is None:
                score = np.zeros(batch.num_rows)
            else:
                cell, offs = _grams(batch.column("url"))
                sums = np.concatenate([[0.0], np.cumsum(table[cell].astype(np.float64))])
                score = (sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(1, np.diff(offs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "llr"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInArrow(run, f"{fields}, llr double")


def _cut_off(held: DataFrame) -> float:
    """The score with the best balanced accuracy over ``held(llr, accepted)``, on a histogram of fixed size."""
    low, high = held.agg(F.min("llr"), F.max("llr")).first()
    if low is None or low == high:
        return 0.0
    bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("llr") - low) / (high - low) * BINS)).cast("int")
    hist = np.zeros((2, BINS))
    for r in held.groupBy(bin_.alias("bin"), "accepted").count().collect():  # at most 2 * BINS rows
        hist[int(r["accepted"]), r["bin"]] = r["count"]
    if not hist.sum(axis=1).all():
        return 0.0
    rejected_below = np.concatenate([[0], np.cumsum(hist[0])]) / hist[0].sum()
    accepted_from = 1 - np.concatenate([[0], np.cumsum(hist[1])]) / hist[1].sum()
    gain = rejected_below + accepted_from
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(low + (high - low) * best[len(best) // 2] / BINS)


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``pages(page_id, url)`` to ``page_id, host, path, rule, verdict, llr``, one row for each row."""
    url = F.col("url")
    rule, verdict = rule_verdicts(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.select("*", rule.alias("rule"), verdict.alias("ruled"))
    decided = parts.where("ruled is not null").select("url", (F.col("ruled") == "allow").alias("accepted"))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    scratch = Scratch(pages.sparkSession)
    counts = decided.where(~held).mapInArrow(_count, "cell long, n_accepted long, n_rejected long").groupBy("cell").agg(F.sum("n_accepted").alias("a"), F.sum("n_rejected").alias("r"))
    got = counts.toArrow()  # at most SYMBOLS ** (ORDER + 1) rows
    a, r = np.zeros(_CELLS), np.zeros(_CELLS)
    at = got.column("cell").to_numpy()
    a[at], r[at] = got.column("a").to_numpy(), got.column("r").to_numpy()
    ratio, cut_off = None, 0.0
    if a.any() and r.any():
        ratio = (log_probabilities(a) - log_probabilities(r)).astype(np.float32)
        cut_off = _cut_off(scratch.table(_scores(decided.where(held), ratio), "held").select("llr", "accepted"))
    method = F.when(F.col("llr") >= cut_off, "allow").otherwise("block")
    scratch.drop()
    return _scores(parts, ratio).select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "llr")
