import math
from fractions import Fraction

import numpy as np
import pytest

from skein.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, `a.b` string, task int, N int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1, 2) for k, v in rows], SCHEMA)


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    scales = np.linspace(1, 3, dim)
    return [[float(np.float32(c)) for c in row] for row in rng.normal(size=(n, dim)) * scales + 5]


def brute(rows):
    """Exact integers and covariance as fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    y = [[n * r[j] - s[j] for j in range(dim)] for r in x]
    v = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(dim)] for i in range(dim)]
    return n, s, [sum(c * c for c in r) for r in y], v


def test_error_free_transformations():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=1000) * 10.0 ** rng.integers(-8, 8, 1000), rng.normal(size=1000)
    s, e = W.two_sum(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(p) + Fraction(q) for x, y, p, q in zip(a, b, s, e))
    p, e = W.outer((np.stack([a, b], 1), np.zeros((1000, 2))))
    assert all(Fraction(x) * Fraction(y) == Fraction(m[0, 1]) + Fraction(f[0, 1]) for x, y, m, f in zip(a, b, p, e))
    high, low = W.by_halves((np.stack([a, a * 1e-30, -a], 0)[:, None, :], np.zeros((3, 1, 1000))))
    assert np.array_equal(high[0] + low[0], a * 1e-30)


def test_covariance_has_nearly_twice_the_digits_of_a_double(spark):
    rows = vectors(300, 5)
    n, s, _, v = brute(rows)
    _, sums, got = W.covariance(frame(spark, enumerate(rows)).select("embedding"), 5, 5, W.integers)
    assert [int(h) + int(e) for h, e in zip(sums[0][0], sums[1][0])] == s
    for i in range(5):
        for j in range(5):
            high = float(got[i, j])
            exact = Fraction(high) + Fraction(float(got[i, j] - np.longdouble(high)))
            assert abs(exact - v[i][j]) <= abs(v[i][i]) * Fraction(1, 2**60)


def test_against_brute_force(spark):
    rows = vectors(400, 12)
    ids = [*range(398), None, 7]
    n, s, deviation, v = brute(rows)
    out = W.whitened(frame(spark, list(zip(ids, rows)))).collect()
    assert len(out) == 400 * 8 and {r.n for r in out} == {400} and {r.component for r in out} == set(range(1, 9))
    assert sorted(r.deviation for r in out if r.component == 1) == sorted(deviation)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-12
    exact = np.array([[float(c) for c in row] for row in v])
    values, q = np.linalg.eigh(exact)
    values, q = values[::-1][:8], q[:, ::-1][:, :8]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r] for r in rows], float)
    want = (x - np.array(s, float) / n) @ q / np.sqrt(values)
    got = np.array([[r.whitened for r in sorted(g, key=lambda r: r.component)] for g in (out[k : k + 8] for k in range(0, len(out), 8))])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-10)
    assert all(np.allclose(got[:, k], want[:, k] * np.sign(got[0, k] * want[0, k]), atol=1e-10) for k in range(8))
    explained = {r.component: r.explained for r in out}
    assert np.allclose([explained[k] for k in range(1, 9)], values / np.trace(exact), rtol=1e-12)


def test_rows_that_cannot_be_used_and_ties(spark):
    rows = vectors(40, 3)
    bad = [None, [], [1.0, None, 2.0], [float("nan")] * 3, [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0]]
    good = [(k, v) for k, v in enumerate(rows)] + [(5, rows[5])] * 3
    out = W.whitened(frame(spark, good + [(100 + k, v) for k, v in enumerate(bad)])).collect()
    assert sorted({r.vec_id for r in out}) == list(range(40)) and {r.n for r in out} == {43}
    five = {(r.component, r.whitened) for r in out if r.vec_id == 5}
    assert len(five) == 3 and sum(r.vec_id == 5 for r in out) == 12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)]])
def test_no_variance_no_rows(spark, rows):
    out = W.whitened(frame(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_reruns_agree_and_equal_rows_are_equal(spark):
    df = frame(spark, enumerate(vectors(200, 4) * 2)).repartition(7)
    a, b = (sorted(map(tuple, W.whitened(df).collect())) for _ in range(2))
    assert a == b and len({r[4] for r in a}) == 200 * 4


def test_far_vectors_have_exact_deviations_or_none():
    fit = W.Whitening(2**20, 1, [0], (np.zeros(1), np.zeros(1)), np.ones((1, 1)), np.ones(1), 1.0)
    assert W.deviations(np.array([[3.0], [2.0**11], [2.0**12]]), fit) == [9 * 2**40, 2**62, None]


def test_refined_eigenvectors():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20, 20))
    m = (a @ a.T).astype(np.longdouble)
    values, q = W.eigen(m)
    assert np.abs(m @ q - q * values).max() < 1e-16 * float(values[0]) and np.abs(q.T @ q - np.eye(20)).max() < 1e-16
    values, q = W.eigen(np.eye(4, dtype=np.longdouble) * 3)
    assert np.allclose(values.astype(float), 3) and np.allclose((q.T @ q).astype(float), np.eye(4))
