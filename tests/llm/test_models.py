"""The trained models of op1 and op10 against the same statistics in plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import toxicity, url_filter
from pixelmill.llm.common import span_hashes

# ---- op1 ----


def folded(url):
    known = "abcdefghijklmnopqrstuvwxyz0123456789/.-_"
    return [known.index(c) + 2 if c in known else 1 for c in re.sub("[A-Z]", lambda m: m[0].lower(), url)]


class Plain:
    """Witten-Bell interpolation over dictionaries of contexts."""

    def __init__(self, urls):
        self.counts = [defaultdict(Counter) for _ in range(url_filter.ORDER + 1)]
        for url in urls:
            s = [0] * url_filter.ORDER + folded(url)
            for i in range(url_filter.ORDER, len(s)):
                for k in range(url_filter.ORDER + 1):
                    self.counts[k][tuple(s[i - k : i])][s[i]] += 1

    def log_probability(self, url):
        s, total = [0] * url_filter.ORDER + folded(url), 0.0
        for i in range(url_filter.ORDER, len(s)):
            p = 1 / url_filter.SYMBOLS
            for k in range(url_filter.ORDER + 1):
                c = self.counts[k].get(tuple(s[i - k : i]))
                if c:
                    n, t = sum(c.values()), len(c)
                    p = (c[s[i]] + t * p) / (n + t)
            total += math.log(p)
        return total


def test_url_models(spark):
    rng = random.Random(12)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    urls = [f"http://{word('abcdef')}.net/de/{word('klmno')}-{word('abc')}.html" for _ in range(150)] + [f"https://{word('uvwxyz')}.com/en/{word('XYZ789')}?{word('p=&')}" for _ in range(150)]
    urls += [f"http://{word('abcdef')}.info/{word('klmno')}" for _ in range(60)] + [f"http://{word('uvwxyz')}.biz/{word('xyz789')}é" for _ in range(60)] + [urls[0]] * 20 + [None, "no scheme"]
    rows = list(enumerate(urls))
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    held = {r["url"]: r["h"] for r in df.select("url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("h")).collect()}
    got = {r["page_id"]: r for r in url_filter.url_verdicts(df).collect()}
    ruled = lambda r: r["rule"] is not None
    learned = {v: [urls[i] for i in range(len(rows)) if ruled(got[i]) and got[i]["verdict"] == v and not held[urls[i]]] for v in ("allow", "block")}
    good, bad = Plain(learned["allow"]), Plain(learned["block"])
    for i, url in rows:
        want = (good.log_probability(url) - bad.log_probability(url)) / len(url.encode()) if url and url.isascii() else None
        if want is not None:
            assert got[i]["llr"] == pytest.approx(want, abs=2e-5)
    # The cut-off lies where no other separates the held-out URLs better, and tells all that no rule decides.
    kept = [(got[i]["llr"], got[i]["verdict"] == "allow") for i in range(len(rows)) if ruled(got[i]) and held[urls[i]]]
    free = [(got[i]["llr"], got[i]["verdict"] == "allow") for i in range(len(rows)) if not ruled(got[i])]
    assert min(s for s, allow in free if allow) > max(s for s, allow in free if not allow)
    cut = (min(s for s, allow in free if allow) + max(s for s, allow in free if not allow)) / 2

    def accuracy(at):
        return sum(s >= at for s, a in kept if a) / sum(a for _, a in kept) + sum(s < at for s, a in kept if not a) / sum(not a for _, a in kept)

    assert accuracy(cut) >= max(accuracy(s) for s, _ in kept) - 0.02
    assert {got[i]["verdict"] for i in range(300, 360)} == {"allow"} and {got[i]["verdict"] for i in range(360, 420)} == {"block"}


# ---- op10 ----


def tokens(text):
    return [t.lower() for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


def cell(token):
    b = np.frombuffer(token, np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0] & np.uint64(2**toxicity.BITS - 1))


def features(token):
    return {(0, token)} | {(n, token[:n]) for n in toxicity.STEMS if len(token) > n}


def odds(n_toxic, n_clean, toxic, clean, prior=0.0):
    a, b = n_toxic + prior + toxicity.LEAST_PRIOR, n_clean + prior + toxicity.LEAST_PRIOR
    d = math.log(a / (toxic + prior + 1)) - math.log(b / (clean + prior + 1))
    return min(toxicity.CEILING, max(toxicity.FLOOR, d - toxicity.DEVIATIONS * math.sqrt(1 / a + 1 / b) - toxicity.DRIFT))


def segments(values):
    """Maximal scoring segments by their definition: the best one, then on either side of it."""
    best = None
    for i in range(len(values)):
        s = 0.0
        for j in range(i, len(values)):
            s += values[j]
            if s > 1e-12 and (best is None or s > best[0] + 1e-9):
                best = (s, i, j + 1)
    if best is None:
        return []
    s, i, j = best
    return segments(values[:i]) + [s] + segments(values[j:])


def test_toxicity_model(spark):
    rng = random.Random(21)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 10))) for _ in range(150)]
    foul = ["vileword", "Nastything", "horrid", "scumbags", "ücky"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(1, 40))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice(foul) + rng.choice(["", "", "s"]) for _ in range(rng.randint(2, 6))]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
        if i % 5:
            labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "..."), (1, "a row of a labelled id again")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert model.trained
    fold = {r["doc_id"]: r["f"] for r in marks.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("f")).collect()}
    learn = {i: t for i, t in labels if fold[i]}

    # Counts by cell and by feature, each in documents, and the prior from all tokens.
    every, by_cell, by_feature = Counter(), {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for i, text in rows:
        own = tokens(text)
        every.update(cell(t) for t in own)
        if i in learn:
            by_cell[learn[i]].update({cell(t) for t in own})
            by_feature[learn[i]].update({f for t in own for f in features(t)})
    n = Counter(learn.values())
    cells = {c: min(-toxicity.DRIFT, odds(by_cell[1][c], by_cell[0][c], n[1], n[0], toxicity.PRIOR * k / sum(every.values()))) for c, k in every.items() if by_cell[0][c] + by_cell[1][c]}
    for c, want in cells.items():
        assert model.cells[c] == pytest.approx(want, abs=1e-5)
    scores = {f: s for f, k in by_feature[1].items() if k >= toxicity.LEAST_TOXIC and (s := odds(k, by_feature[0][f], n[1], n[0])) > 0}
    assert sorted(np.round(model.scores.astype(float), 4)) == sorted(np.round(list(scores.values()), 4)) and scores

    def value(token):
        return max([cells.get(cell(token), -toxicity.DRIFT), *(scores[f] for f in features(token) if f in scores)])

    # Lambda and the location from clean texts that counts leave out.
    held = [(text, t) for i, text in rows for t in [dict(labels).get(i)] if t is not None and not fold[i]]
    clean = [value(t) for text, mark in held if not mark for t in tokens(text)]
    below = [r for r in toxicity.RATES if np.mean(np.exp(r * np.array(clean))) < 1]
    assert model.rate == pytest.approx(below[-1] if below else toxicity.RATES[0])

    def measured(text, location):
        found = [model.rate * s - math.log(len(tokens(text))) - location for s in segments([value(t) for t in tokens(text)])]
        return max([0.0, *(max(z + toxicity.SHIFT, 0.01) for z in found)]), sum(z for z in found if z > toxicity.SIGNIFICANT)

    tops = [top for text, mark in held if not mark for top in [measured(text, 0.0)[0]] if top > 0]
    location = float(np.median(np.array(tops) - toxicity.SHIFT) + math.log(math.log(2))) if len(tops) >= 8 else 0.0
    assert model.location == pytest.approx(location, abs=1e-4)

    # The weights are the optimum of the ridge logistic loss, and scores follow from them.
    design = lambda text: np.array([1.0, min(60.0, measured(text, location)[0]) / 10, math.log1p(measured(text, location)[1])])
    x, y, w = np.array([design(text) for text, _ in held]), np.array([t for _, t in held]), np.array(model.weights)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 1e-2 * w).max() < 1e-3
    got = {(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()}
    for i, text in rows:
        want = 1 / (1 + math.exp(-float(np.clip(design(text) @ w, -30, 30))))
        assert any(d == i and s == pytest.approx(want, abs=1e-4) for d, s in got)
