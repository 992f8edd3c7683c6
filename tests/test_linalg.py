import random
from fractions import Fraction

import numpy as np
import pytest

from tensorloom.operators import linalg as L
from tensorloom.operators.frame import TensorFrame

RNG = np.random.default_rng(8)


def test_batched(spark):
    x = RNG.normal(size=(3, 4, 4))
    t = TensorFrame.of_numpy(spark, x)
    np.testing.assert_allclose(L.invert(t).numpy() @ x, np.broadcast_to(np.eye(4), x.shape), atol=1e-9)
    u, s, v = L.svd(TensorFrame.of_numpy(spark, x[0, :3]))
    full = np.zeros((3, 4))
    np.fill_diagonal(full, s.numpy())
    np.testing.assert_allclose(u.numpy() @ full @ v.numpy().T, x[0, :3], atol=1e-9)
    np.testing.assert_allclose(L.pseudo_invert(TensorFrame.of_numpy(spark, x[0, :3])).numpy(), np.linalg.pinv(x[0, :3]), atol=1e-9)
    values, vectors = L.symmetric_eigen(TensorFrame.of_numpy(spark, x[0] + x[0].T))
    w = vectors.numpy()
    np.testing.assert_allclose(w @ np.diag(values.numpy()) @ w.T, x[0] + x[0].T, atol=1e-9)
    with pytest.raises(Exception, match="singular"):
        L.invert(TensorFrame.of_numpy(spark, np.ones((2, 2)))).numpy()


def test_whitening(spark):
    x = RNG.normal(size=(300, 5)) @ RNG.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "k long, x array<double>").repartition(4)
    for zca in (False, True):
        w = L.Whitening.fit(df, "x", zca=zca)
        y = w.transform(df, "x")
        white = np.array([r.x for r in y.orderBy("k").collect()])
        np.testing.assert_allclose(np.cov(white.T, bias=True), np.eye(5), atol=1e-8)
        np.testing.assert_allclose(np.array([r.x for r in w.inverse(y, "x").orderBy("k").collect()]), x, atol=1e-8)
    assert len(L.Whitening.fit(df, "x", 2).transform(df, "x").first().x) == 2


def test_whitening_of_large_means(spark):
    """Means of 1e8 beside deviations of 1."""
    x = RNG.normal(size=(400, 3)) * [1.0, 2.0, 3.0] + 1e8
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "k long, x array<double>").repartition(4)
    w = L.Whitening.fit(df, "x")
    np.testing.assert_allclose(np.sort(w.variances), np.sort(np.linalg.eigvalsh(np.cov((x - 1e8).T, bias=True))), rtol=1e-6)
    with pytest.raises(ValueError, match="no rows"):
        L.Whitening.fit(df.limit(0), "x")


def test_exact():
    rng = random.Random(234)
    for _ in range(60):
        r, c = rng.randrange(1, 6), rng.randrange(1, 6)
        m = [[rng.randrange(-5, 6) for _ in range(c)] for _ in range(r)]
        u, s, v = L.smith_normal_form(m)
        assert L._times(L._times(u, m), v) == s
        d = [s[k][k] for k in range(min(r, c))]
        assert all(x >= 0 for x in d) and all((b == 0) if a == 0 else b % a == 0 for a, b in zip(d, d[1:]))
        assert all(s[i][j] == 0 for i in range(r) for j in range(c) if i != j)
        assert abs(round(np.linalg.det(np.array(u, float)))) == 1 == abs(round(np.linalg.det(np.array(v, float))))
        q = L.integer_inverse(m)
        assert L._times(L._times(m, q), m) == m
        i, left, null = L.general_inverse(m)
        assert L._times(L._times(m, i), m) == m
        assert all(x == 0 for row in L._times(left, m) for x in row) if left else True
        assert all(x == 0 for row in L._times(m, null) for x in row)
        a, b = rng.randrange(-99, 99), rng.randrange(-99, 99)
        x, y, g = L.bezout(a, b)
        assert x * a + y * b == g == __import__("math").gcd(a, b)
    assert L.row_echelon([[0, 2], [1, 1]])[0] == [[Fraction(1), 0], [0, Fraction(1)]]
