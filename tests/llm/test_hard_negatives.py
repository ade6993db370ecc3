"""Hard negatives against brute force over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, d string, cell string, x string"


def brute(rows, dim, every=10):
    t = []
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or len(v) != dim or any(c is None or not math.isfinite(c) or abs(c) > 1e6 for c in v):
            continue
        t.append((i, label, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = []
    for a in sorted({r[0] for r in t if r[0] % every == 0}):
        _, label, q = min(r for r in t if r[0] == a)
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in t if i != a)
        for s, positive, _ in [r for r in scored if r[2] == label][:5]:
            fit = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, positive, k, i, -s, -n) for k, (n, i, _) in enumerate(fit, 1)]
    return sorted(out)


def fixture(kind):
    rng = random.Random(kind)
    if kind == "clusters":
        centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
        rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(4), "a", "b", "c") for i in range(900)]
    elif kind == "ties":  # few kinds of small vectors: scores tie everywhere
        rows = [(i, [float(rng.randint(-1, 1)) for _ in range(4)], rng.randrange(3), "a", "b", "c") for i in range(500)]
    else:  # a third of all rows copies of one vector, and of one label
        rows = [(i, [1.0, 0.5, 0.0, 0.25] if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(4)], 1 if i % 2 else rng.randrange(30), "a", "b", "c") for i in range(600)]
    dim = len(rows[0][1])
    rows += [(5, rows[5][1], 2, "a", "b", "c"), (5, rows[5][1], 2, "a", "b", "c"), (10, rows[20][1], 9, "a", "b", "c")]
    rows += [(2000, None, 1, "a", "b", "c"), (2010, rows[3][1], None, "a", "b", "c"), (None, rows[3][1], 1, "a", "b", "c"), (2020, [None] + rows[3][1][1:], 1, "a", "b", "c")]
    rows += [(2030, [float("nan")] * dim, 1, "a", "b", "c"), (2040, [float("-inf")] * dim, 1, "a", "b", "c"), (2050, [], 1, "a", "b", "c"), (2060, [1.0], 1, "a", "b", "c"), (2070, [1e30] * dim, 1, "a", "b", "c")]
    rows += [(2080, [0.0] * dim, 1, "a", "b", "c"), (2090, [0.01] * dim, 77, "a", "b", "c")]  # scores of zero; a label of its own
    return rows, dim


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies"])
def test_hard_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(hn, "CELL_ROWS", 40)
    monkeypatch.setattr(hn, "SAMPLE", 100)
    monkeypatch.setattr(hn, "PIVOTS", 6)
    monkeypatch.setattr(hn, "TILE_ANCHORS", 30)
    monkeypatch.setattr(hn, "TILE_CELLS", 20)
    rows, dim = fixture(kind)
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, dim) and got


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (10, 16))
    x = np.round(centres[rng.integers(10, size=2000)] + rng.normal(0, 20, (2000, 16))).astype(np.int64)
    q = x[::100]
    pivots = hn.Pivots(np.arange(500), np.zeros(500, np.int64), x[:500], int((x * x).sum(1).max()))
    d, dq, s, ruled_out = pivots.of_rows(x), pivots.of_anchors(q), hn.scores(x, q), 0
    for i in range(len(q)):
        low, high = pivots.bounds(dq[i], hn._norm(q[i]), d, d)
        assert (low <= s[:, i]).all() and (s[:, i] <= high).all()
        ruled_out += (high < np.sort(s[:, i])[-5]).sum()
    assert ruled_out > 0.5 * s.size


def test_large_scores_are_exact():
    rng = random.Random(2)
    x = np.array([[rng.randint(-(2**29), 2**29) for _ in range(8)] for _ in range(30)], np.int64)
    assert hn.scores(x, x[:3]).tolist() == [[sum(a * b for a, b in zip(r, q)) for q in x[:3].tolist()] for r in x.tolist()]


def test_empty_and_lonely(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, "", "", "")], SCHEMA)
    assert hn.hard_negatives(one, F.col("vec_id") % 10 == 0).collect() == []
    none = spark.createDataFrame([(1, [1.0, 2.0], 1, "", "", ""), (2, [1.0, 2.0], 1, "", "", "")], SCHEMA)
    assert hn.hard_negatives(none, F.col("vec_id") % 10 == 0).collect() == []
