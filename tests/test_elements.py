import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators.frame import TensorFrame
from tensorloom.operators.loop import Loop, multivariate_normal
from tensorloom.plans.elements import element, elements, elements_gradient, index, total, total_index, where_equal, within
from tensorloom.plans.expr import const, unary, var

X, Y = np.arange(6, dtype=float).reshape(2, 3) / 3 - 0.5, np.arange(12, dtype=float).reshape(3, 4) / 5 - 1


def check_gradient(spark, shape, e, arrays, wanted):
    """The derivative against central differences of the evaluation in DataFrames."""
    seed = np.random.default_rng(1).normal(size=shape)
    frames = {n: TensorFrame.of_numpy(spark, a) for n, a in arrays.items()}
    got = elements_gradient(e, frames, wanted, TensorFrame.of_numpy(spark, seed)).numpy()
    want = np.zeros_like(arrays[wanted])
    for at in [tuple(0 for _ in want.shape), tuple(n - 1 for n in want.shape), (0, *(n - 1 for n in want.shape[1:]))]:
        sums = []
        for step in (1e-5, -1e-5):
            moved = arrays[wanted].copy()
            moved[at] += step
            sums.append((elements(shape, e, frames | {wanted: TensorFrame.of_numpy(spark, moved)}, spark).numpy() * seed).sum())
        assert got[at] == pytest.approx((sums[0] - sums[1]) / 2e-5, abs=1e-6)
    return got, seed


def test_product(spark):
    k = total_index("k")
    e = total("k", 0, 2, element("x", index(0), k) * element("y", k, index(1)))
    frames = {"x": TensorFrame.of_numpy(spark, X), "y": TensorFrame.of_numpy(spark, Y)}
    np.testing.assert_allclose(elements((2, 4), e, frames, spark).numpy(), X @ Y)
    seed = np.random.default_rng(2).normal(size=(2, 4))
    np.testing.assert_allclose(elements_gradient(e, frames, "x", TensorFrame.of_numpy(spark, seed)).numpy(), seed @ Y.T)
    np.testing.assert_allclose(elements_gradient(e, frames, "y", TensorFrame.of_numpy(spark, seed)).numpy(), X.T @ seed)


def test_conditions_and_nesting(spark):
    k, m = total_index("k"), total_index("m")
    below = within(index(0) - 1, 0, 1, element("x", index(0) - 1, index(1)))  # the row above, 0 where there is none
    frames = {"x": TensorFrame.of_numpy(spark, X), "y": TensorFrame.of_numpy(spark, Y)}
    np.testing.assert_allclose(elements((2, 3), below, frames, spark).numpy(), np.vstack([np.zeros(3), X[0]]))
    np.testing.assert_allclose(elements((3, 3), where_equal(index(0), index(1), 2, 0.5), {}, spark).numpy(), np.where(np.eye(3) > 0, 2, 0.5))
    nested = unary("tanh", total("k", 0, index(0), element("x", index(0), k) * total("m", k, 3, element("y", k, m) ** 2)))
    want = np.tanh([sum(X[i, a] * sum(Y[a, b] ** 2 for b in range(a, 4)) for a in range(i + 1)) for i in range(2)])
    np.testing.assert_allclose(elements((2,), nested, frames, spark).numpy(), want)
    check_gradient(spark, (2,), nested, {"x": X, "y": Y}, "y")
    got, seed = check_gradient(spark, (2, 3), below, {"x": X}, "x")
    np.testing.assert_allclose(got, np.vstack([seed[1], np.zeros(3)]))
    assert elements((), total("k", 1, 0, const(1)), {}, spark).numpy() == 0
    with pytest.raises(Exception, match="outside"):
        elements((3,), element("x", index(0), index(0)), frames, spark).df.collect()


def test_loop(spark):
    step = unary("tanh", var("state") * var("a") + var("value") * var("b"))
    rows = [(s, k, np.sin(k + s), 0.5 + k % 3) for s in range(4) for k in range(s * 5 + 1)]
    df = spark.createDataFrame([(s, k, float(v), w) for s, k, v, w in rows], "s long, k long, x double, w double").repartition(3)
    loop, pars = Loop(step, "s", ["k"], "x", 0.3), {"a": 0.7, "b": -0.4}

    def objective(a, b, start, values):
        out, states = 0.0, {}
        for (s, k, _, w), v in zip(rows, values, strict=True):
            states[s] = np.tanh(states.get(s, start) * a + v * b)
            out += w * states[s]
        return out

    values = np.array([r[2] for r in rows])
    states = {(r.s, r.k): r.state for r in loop.states(df, pars).collect()}
    assert sum(w * states[s, k] for s, k, _, w in rows) == pytest.approx(objective(0.7, -0.4, 0.3, values))
    h, row = 1e-6, loop.gradient(df, "w", pars).first()
    assert row["a"] == pytest.approx((objective(0.7 + h, -0.4, 0.3, values) - objective(0.7 - h, -0.4, 0.3, values)) / (2 * h), rel=1e-5)
    assert row["b"] == pytest.approx((objective(0.7, -0.4 + h, 0.3, values) - objective(0.7, -0.4 - h, 0.3, values)) / (2 * h), rel=1e-5)
    assert row["start"] == pytest.approx((objective(0.7, -0.4, 0.3 + h, values) - objective(0.7, -0.4, 0.3 - h, values)) / (2 * h), rel=1e-5)
    by = {(r.s, r.k): r.d_value for r in loop.adjoints(df, "w", pars).collect()}
    for n in (0, 3, len(rows) - 1):
        moved = [values + h * (np.arange(len(rows)) == n) * sign for sign in (1, -1)]
        assert by[rows[n][:2]] == pytest.approx((objective(0.7, -0.4, 0.3, moved[0]) - objective(0.7, -0.4, 0.3, moved[1])) / (2 * h), abs=1e-7)
    assert loop.gradient(df.where(F.lit(False)), "w", pars).first()["a"] == 0


def test_multivariate_normal(spark):
    covariance = np.array([[2.0, 0.6, 0.0], [0.6, 1.0, 0.0], [0.0, 0.0, 0.0]])
    draws = multivariate_normal(spark, 20000, [1, -2, 5], covariance, seed=3).numpy()
    np.testing.assert_allclose(draws.mean(0), [1, -2, 5], atol=0.06)
    np.testing.assert_allclose(np.cov(draws.T), covariance, atol=0.08)
    with pytest.raises(ValueError):
        multivariate_normal(spark, 2, [0, 0], np.array([[1, 2], [2, 1]]))
