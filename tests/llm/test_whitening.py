"""Whitening against whole numbers, and the eigen-solve against a slow one and against LAPACK's."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tracequarry.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, vec string, n string, component string, white string"


def vectors(spark, rows):
    """Vectors with extra columns whose names clash with those that the operator uses inside."""
    return spark.createDataFrame([(i, v, 1, 2, "v", "n", "c", "w") for i, v in rows], SCHEMA)


def exact(rows):
    """n, sums and the covariance as fractions of vectors of one length."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    off = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in off), n**3) for j in range(len(sums))] for i in range(len(sums))]
    return x, n, sums, off, cov


def check(rows, got):
    """got: the operator's rows of vectors of one length."""
    x, n, sums, off, cov = exact([v for _, v in rows])
    v = np.array([[float(c) for c in r] for r in cov])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(w.K, len(sums))
    assert len(got) == k * len(rows)
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, sum(c * c for c in o)) for (i, _), o in zip(rows, off, strict=True))
    white = (np.array(off, float) / n) @ axes[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        mine = sorted(r.whitened for r in got if r.component == c + 1)
        assert min(np.abs(np.sort(s * white[:, c]) - mine).max() for s in (1, -1)) < 1e-9
    assert all(abs(r.explained * np.trace(v) / values[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 and r.n == n and r.deviation == r.deviation_wide for r in got)


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(a)) for a in rng.normal(size=5) * [1, 2, 3, 4, 0.01]]) for i in range(60)]
    rows += [rows[3]] * 20 + [(None, rows[5][1]), (7, rows[6][1])]
    other = [(1000 + i, [float(np.float32(a)) for a in rng.normal(size=11)]) for i in range(40)]
    bad = [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0, 4.0]), (4, [1.0, float("nan"), 2.0, 3.0, 4.0]), (5, [float("inf")] * 5), (6, [1.0, -float("inf"), 1.0, 1.0, 1.0])]
    got = w.whiten(vectors(spark, rows + other + bad).repartition(7)).collect()
    check(rows, [r for r in got if r.n == len(rows)])
    check(other, [r for r in got if r.n == len(other)])
    assert len(got) == 5 * len(rows) + 8 * len(other)


def test_lengths_are_taken_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(d * 100 + i, rng.normal(size=d).tolist()) for d in (2, 3, 4) for i in range(20)]
    want = sorted(map(tuple, w.whiten(vectors(spark, rows)).drop("whitened").collect()), key=str)
    monkeypatch.setattr(w, "MODEL_BYTES", 1)
    assert w._model_chunks([2, 3, 4], 8) == [[2], [3], [4]]
    assert sorted(map(tuple, w.whiten(vectors(spark, rows)).drop("whitened").collect()), key=str) == want


def test_no_spread_and_no_rows(spark):
    got = w.whiten(vectors(spark, [(i, [1.0, 2.0, 3.0]) for i in range(9)])).collect()
    assert len(got) == 27 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in got)
    flat = w.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()  # one direction only
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-12 for r in flat)
    assert w.whiten(vectors(spark, [])).collect() == []
    far = w.whiten(vectors(spark, [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 3.0])])).collect()
    assert all(r.deviation is not None or r.deviation_wide > 1 << 63 for r in far) and any(r.deviation is None for r in far)


def test_the_offset_costs_no_digits():
    """Sums in double-double are right to over 90 bits, however rows are cut and merged."""
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(5000, 3)) * 1024 * [1, 1e-2, 1e4]) + 100000
    n, sums = len(x), [int(v) for v in x.sum(axis=0)]
    mean = w.mean_of(n, sums)
    parts = []
    for at in range(0, n, 700):
        rows = w.centred(x[at : at + 700], mean)
        parts.append(w.crossed(rows, rows))
    for order in (parts, parts[::-1], parts[1::2] + parts[::2]):
        total = order[0]
        for p in order[1:]:
            total = w.added(total, p)
        for i in range(3):
            for j in range(3):
                want = Fraction(sum((n * int(a) - sums[i]) * (n * int(b) - sums[j]) for a, b in zip(x[:, i], x[:, j], strict=True)), n * n)
                scale = abs(Fraction(float(np.abs(total[0]).max())))
                assert abs(Fraction(float(total[0][i, j])) + Fraction(float(total[1][i, j])) - want) <= scale * Fraction(1, 1 << 90)


def test_error_free_steps():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=200) * 2.0 ** rng.integers(-30, 30, 200), rng.normal(size=200)
    for s, e, p, q, x, y in zip(*w.two_sum(a, b), *w.two_product(a, 12345.678), a, b, strict=True):
        assert Fraction(float(s)) + Fraction(float(e)) == Fraction(float(x)) + Fraction(float(y))
        assert Fraction(float(p)) + Fraction(float(q)) == Fraction(float(x)) * Fraction(12345.678)


def matrices():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 8, 33, 90):
        x = rng.normal(size=(2 * d, d))
        yield x.T @ x
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    yield from (np.eye(20), np.zeros((6, 6)), np.ones((30, 30)), np.diag(np.arange(30.0)), np.diag(np.ones(9), 1) + np.diag(np.ones(9), -1))
    yield from ((q * np.repeat([1.0, 2.0, 3.0, 1e-9], 10)) @ q.T, (q * np.logspace(0, -30, 40)) @ q.T, (q * (1 + 1e-13 * np.arange(40))) @ q.T)


@pytest.mark.parametrize("a", list(matrices()))
def test_eigen_solve(a):
    a = (a + a.T) / 2
    want, size = np.linalg.eigvalsh(a)[::-1], max(np.abs(a).max() * len(a), 1e-300)
    values, x = w.eigen(a, np.zeros_like(a))
    assert np.abs(values - want).max() <= 1e-14 * size and np.abs(a @ x - x * values).max() <= 1e-14 * size
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    diagonal, beside, q = w.tridiagonal(a)
    t = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
    assert np.abs(q @ t @ q.T - a).max() <= 1e-14 * size
    values, x = w.divide_and_conquer(diagonal, beside)
    assert np.abs(t @ x - x * values).max() <= 1e-14 * size and np.abs(x.T @ x - np.eye(len(a))).max() < 1e-13
