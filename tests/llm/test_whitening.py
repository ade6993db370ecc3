"""Whitening against a brute-force version in whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pixelmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, component string"


def brute(rows, most):
    x = [(r[0], [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]]) for r in rows if r[1] and len(r[1]) == 6 and all(c is not None and math.isfinite(c) and abs(c) < 2**52 for c in r[1])]
    fit = sorted({tuple(v) for _, v in x})
    n, dim = len(fit), 6
    s = [sum(v[i] for v in fit) for i in range(dim)]
    cov = [[float(Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit), n**3)) for j in range(dim)] for i in range(dim)]
    values, axes = np.linalg.eigh(np.array(cov))
    order = np.argsort(-values)[:most]
    out = {}
    for k, (i, v) in enumerate(x):
        centred = np.array([float(Fraction(n * v[d] - s[d], n)) for d in range(dim)])
        deviation = sum((n * v[d] - s[d]) ** 2 for d in range(dim))
        for c, o in enumerate(order, 1):
            out.setdefault((i, c), []).append((n, deviation, centred @ axes[:, o] / math.sqrt(values[o]), values[o] / sum(values)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, [rng.gauss(k, 1 + k) for k in range(6)], 1, 7, "x", "y") for i in range(300)]
    out += [(1000 + i, [1.0] * 6, 2, 7, "x", "y") for i in range(150)]  # copies, a third of all rows
    out += [(5, [0.5] * 6, 1, 7, "x", "y")] * 2 + [(None, [0.25, -0.001, 0.0, 0.0, -1.0, 2.0], 1, 7, "x", "y")]
    out += [(2000, None, 1, 7, "x", "y"), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 7, "x", "y"), (2002, [float("nan")] * 6, 1, 7, "x", "y"), (2003, [float("inf")] + [0.0] * 5, 1, 7, "x", "y")]
    return out + [(2004, [], 1, 7, "x", "y"), (2005, [1.0] * 5, 1, 7, "x", "y"), (2006, [1e30] * 6, 1, 7, "x", "y")]


def test_whitening(spark, rows):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(7), components=4).collect()
    want = brute(rows, 4)
    assert len(got) == sum(map(len, want.values()))
    sign = {}
    for r in got:
        n, _, white, explained = next(w for w in want[r["vec_id"], r["component"]] if w[1] == r["deviation"])
        assert r["n"] == n
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9
        if abs(white) > 1e-3:
            s = sign.setdefault(r["component"], 1 if r["whitened"] * white > 0 else -1)
            assert r["whitened"] * s == pytest.approx(white, rel=1e-7)
    assert set(sign) == {1, 2, 3, 4}


def test_exact_beyond_64_bits():
    """Limbs and sums of integers that no double and no long holds."""
    rng = random.Random(1)
    x = np.array([[rng.randint(-(2**60), 2**60) for _ in range(3)] for _ in range(50)], np.int64)
    centre = whitening.Centre(50, [int(v) for v in x.astype(object).sum(0)])
    y, bound = centre(x)
    assert y.dtype == object
    slices = whitening.limbs(y, bound)
    assert (sum(d.astype(np.int64).astype(object) * (1 << whitening.LIMB * k) for k, d in enumerate(slices)) == y).all()
    gram = whitening.Gram(3)
    gram.add(y, bound)
    assert (gram.fold() == y.T @ y).all()
    assert (whitening._unpacked(whitening._packed(gram.total[0])) == gram.total[0]).all()


def test_blocks_add_up():
    rng = np.random.default_rng(2)
    y = rng.integers(-(2**30), 2**30, (whitening.BLOCK * 3 + 5, 2))
    gram = whitening.Gram(2)
    gram.add(y, 2**30)
    assert (gram.fold() == y.astype(object).T @ y.astype(object)).all()


def test_degenerate(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).collect() == []
    one = spark.createDataFrame([(i, [1.0, 2.0], 0, 0, "", "") for i in range(9)], SCHEMA)
    assert whitening.whitened(one).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0, 0, "", "") for i in range(9)], SCHEMA)  # rank one
    got = whitening.whitened(line).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9
    assert all(r["explained"] == pytest.approx(1) for r in got)
