"""Whitening against exact fractions, and its sums against big integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pagemill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("bits", [1, 19, 20, 21, 40, 62, 90])
def test_gram_is_exact(bits):
    rng = random.Random(bits)
    rows = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(whitening.BLOCK + 300)]
    rows[0], rows[1], rows[2] = [-1] * 5, [0] * 5, [-(1 << bits)] * 5
    y = np.array(rows, dtype="i8" if bits < 63 else object)
    got = whitening.gram(y)
    for i in range(5):
        for j in range(5):
            assert got[i, j] == sum(r[i] * r[j] for r in rows)
    assert (whitening.gram(y[:1]) == 1).all() and (whitening.gram(y[1:2]) == 0).all()


def exact(rows):
    """(x of each whole row, n, S, V) in integers and fractions."""
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = list(map(list, {tuple(x) for _, x in whole}))
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    v = [[Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n**3) for b in range(d)] for a in range(d)]
    return whole, n, s, v


def test_whitened_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + k) + (3 if k == 2 else 0) for k in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(500)] + [(None, rows[9][1]), (7, rows[7][1])]
    odd = [(2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2005, [1.0, 2.0])]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA + ", n int, x string").repartition(5)
    whole, n, s, v = exact(rows)
    got = whitening.whiten(d).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    values, axes = np.linalg.eigh(np.array(v, dtype=float))
    trace, by = float(sum(v[k][k] for k in range(6))), {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    for i, x in whole:
        y = np.array([float(Fraction(n * x[k] - s[k], n)) for k in range(6)])
        for c in range(1, 5):
            r, e = by[i][c], values[-c]
            assert r.deviation == sum((n * x[k] - s[k]) ** 2 for k in range(6))
            assert abs(abs(r.whitened) - abs(y @ axes[:, -c]) / math.sqrt(e)) < 1e-9 and abs(r.explained - e / trace) < 1e-12
    for c in range(1, 5):  # one sign for all rows
        signs = {np.sign(by[i][c].whitened * (np.array([float(n * x[k] - s[k]) for k in range(6)]) @ axes[:, -c])) for i, x in whole if abs(by[i][c].whitened) > 1e-6}
        assert len(signs) == 1


def test_flat_short_and_huge(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], SCHEMA)).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True} and line[0].identity_error < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 1.0])], SCHEMA)).collect()
    assert len(huge) == 6 and all(r.deviation is None or r.vec_id == 3 for r in huge) and all(math.isfinite(r.whitened) for r in huge if r.component == 1)
    empty = spark.createDataFrame([(1, None), (2, [])], SCHEMA)
    assert whitening.whiten(empty).isEmpty() and whitening.whiten(empty.where("false")).isEmpty()


def test_table(spark):
    got = whitening.query(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.where("identity_error > 1e-9 or whitened is null").isEmpty()
