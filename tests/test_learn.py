import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import scalar
from tensorloom.operators import learn as L
from tensorloom.operators import scan as S
from tensorloom.operators.frame import TensorFrame
from tensorloom.plans.expr import Expr, const, sigmoid, stop_gradient, unary, var, where_greater
from tensorloom.sources import tensors

X, Y = var("x"), var("y")
CASES = [X * Y + X / Y, unary("tanh", X * 2) ** 2, unary("exp", -X * X) * unary("sin", Y), unary("log", X + 3) - unary("sqrt", Y + 4), X**Y, unary("abs", X - Y), where_greater(X, Y, X * X, Y), sigmoid(X * Y), Expr("max_elemwise", (X, Y * 2)), unary("atan", X) + unary("cosh", Y) + unary("asin", X / 9) + unary("tan", Y / 5)]


@pytest.mark.parametrize("e", CASES)
def test_gradient_by_differences(e):
    at = {"x": 0.7, "y": 1.3}
    for n, g in e.gradient(["x", "y"]).items():
        moved = [e.value(at | {n: at[n] + s}) for s in (1e-5, -1e-5)]
        assert g.value(at) == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-6)


def test_columns_and_trees(spark):
    df = spark.createDataFrame([(0.7, 1.3)], "x double, y double")
    row = df.select(*(e.column().alias(f"e{k}") for k, e in enumerate(CASES))).first()
    for k, e in enumerate(CASES):
        assert row[k] == pytest.approx(e.value({"x": 0.7, "y": 1.3}))
    e = X * Y + const(0) * X
    assert e.simple() == X * Y and e.contains(Y) and e.subst(Y, X).simple() == X * X and (X * Y).count_ops() == 3
    assert stop_gradient(X).gradient(["x"])["x"] == const(0)


def test_training(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(3 * a - 1)) for a in x], "x double, y double").cache()
    fit = L.linear_regression(df, ["x"], "y")
    assert fit["x"] == pytest.approx(3) and fit["bias"] == pytest.approx(-1)
    loss = (var("w") * X + var("b") - Y) ** 2
    for optimizer in (L.GradientDescent(0.3), L.Adam(0.3), L.RMSprop(0.2)):
        got = L.train(df, df, loss, {"w": 0.0, "b": 0.0}, optimizer, max_iterations=25, target=0.05)
        assert min(x[2] for x in got.log) < 0.2 * got.log[0][2]
    scores = L.quality(df.withColumn("p", F.col("y") + 0.1), "p", "y").first()
    assert scores.mse == pytest.approx(0.01)
    probabilities = df.limit(1).select(L.softmax(F.array(F.lit(1000.0), F.lit(1001.0))).alias("p"), L.log_softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("q")).first()
    assert sum(probabilities.p) == pytest.approx(1) and probabilities.q[0] == pytest.approx(-math.log(2))
    known = np.linspace(-2, 2, 9)
    gp = L.gp_predict(df.limit(5), "x", known, np.sin(known), L.squared_exponential(1.0, 1.0)).toPandas()
    near = gp[gp.x.abs() < 2]
    np.testing.assert_allclose(near.gp_mean, np.sin(near.x), atol=0.02)


def test_scans(spark):
    rows = [(k, i, float((i * 7 + k) % 5)) for k in range(3) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, i long, x double").repartition(4)
    want = {}
    for k in range(3):
        s = 0.0
        for i in range(150):
            s = 0.5 * s + (i * 7 + k) % 5
            want[k, i] = s
    for got in (S.scan(df, "k", ["i"], "x", F.lit(0.0), lambda s, v, n: s * 0.5 + v, "s"), S.exponential_scan(df, "k", ["i"], "x", 0.5, "s", 16)):
        found = {(r.k, r.i): r.s for r in got.collect()}
        assert found.keys() == want.keys() and all(found[x] == pytest.approx(want[x]) for x in want)


def test_contract_and_interpolate(spark):
    a, b = np.random.default_rng(1).normal(size=(2, 3, 4)), np.random.default_rng(2).normal(size=(4, 3))
    np.testing.assert_allclose(S.contract("abc,cb->a", TensorFrame.of_numpy(spark, a), TensorFrame.of_numpy(spark, b)).numpy(), np.einsum("abc,cb->a", a, b))
    table = np.arange(6.0) ** 2
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 4.5, 5.0, 6.0)], "x double")
    i = S.Interpolator(table, [0], [5])
    assert [r[0] for r in df.select(i(F.col("x"))).collect()] == [0, 0, 0.5, 20.5, 25, 25]
    assert [r[0] for r in df.select(S.Interpolator(table, [0], [5], "zero")(F.col("x"))).collect()] == [0, 0, 0.5, 20.5, 0, 0]
    assert [r[0] for r in df.select(i.derivative(0)(F.col("x"))).collect()] == [0, 1, 1, 9, 0, 0]
    flat = S.Interpolator(np.add.outer(np.arange(3.0), 10 * np.arange(4.0)), [0, 0], [2, 3])
    assert df.limit(1).select(flat(F.lit(1.25), F.lit(0.5))).first()[0] == pytest.approx(6.25)


def test_erf_and_cdf(spark):
    at = np.linspace(-4, 4, 81)
    got = spark.createDataFrame([(float(x),) for x in at], "x double").select("x", scalar.erf(F.col("x")).alias("e"), scalar.normal_cdf(F.col("x"), 1.0, 4.0).alias("c")).collect()
    for r in got:
        assert abs(r.e - math.erf(r.x)) < 2e-7 and abs(r.c - (1 + math.erf((r.x - 1) / math.sqrt(8))) / 2) < 2e-7


def test_derivative_deviation():
    e = unary("tanh", var("a") * var("b")) / (var("a") ** 2 + 1)
    assert max(L.derivative_deviation(e, {"a": 0.4, "b": -1.2}).values()) < 1e-8
    assert L.lq(np.array([1.0, -2.0]), 3) == 9


def test_gaussian_process_with_slopes(spark):
    at = np.linspace(0, 6, 25)
    df = spark.createDataFrame([(float(x),) for x in at], "x double")
    known = np.arange(0, 7, 1.5)
    got = L.gp_predict_slopes(df, "x", (known, np.sin(known)), (known, np.cos(known)), 1.0, 1.0).collect()
    for r in got:
        assert r.gp_mean == pytest.approx(np.sin(r.x), abs=0.05) and r.gp_slope_mean == pytest.approx(np.cos(r.x), abs=0.15) and r.gp_variance > -1e-6
    none = np.zeros(0)
    plain = L.gp_predict(df, "x", known, np.sin(known), L.squared_exponential(1.0, 1.0), 0.1).collect()
    same = L.gp_predict_slopes(df, "x", (known, np.sin(known)), (none, none), 1.0, 1.0, 0.1).collect()
    np.testing.assert_allclose([(r.gp_mean, r.gp_variance) for r in same], [(r.gp_mean, r.gp_variance) for r in plain], atol=1e-9)
    h = {r.x: r for r in L.gp_predict_slopes(spark.createDataFrame([(0.7,), (0.7001,)], "x double"), "x", (known, np.sin(known)), (known[:2], np.cos(known[:2])), 1.0, 1.0, 0.1, 0.1).collect()}
    assert h[0.7].gp_slope_mean == pytest.approx((h[0.7001].gp_mean - h[0.7].gp_mean) / 1e-4, rel=1e-3)


def test_parameters_and_image_records(spark, tmp_path):
    parameters = {"w": np.arange(6.0).reshape(2, 3), "b": 1.5}
    tensors.save_parameters(spark, parameters, str(tmp_path / "p"))
    got = tensors.load_parameters(spark, str(tmp_path / "p"))
    assert set(got) == {"w", "b"} and got["b"].shape == () and (got["w"] == parameters["w"]).all() and got["b"] == 1.5
    data = np.random.default_rng(1).integers(0, 256, (3, 13), np.uint8)
    (tmp_path / "batch.bin").write_bytes(data.tobytes())
    rows = tensors.read_image_records(spark, str(tmp_path / "batch.bin"), (3, 2, 2)).orderBy("record").collect()
    assert [r.label for r in rows] == data[:, 0].tolist() and [r.image for r in rows] == data[:, 1:].tolist()
    scaled = tensors.read_scaled_records(spark, str(tmp_path / "batch.bin"), (3, 2, 2), 256).orderBy("record").collect()
    np.testing.assert_allclose([r.image for r in scaled], data[:, 1:] / 255)
    assert [r.label.index(1.0) for r in scaled] == data[:, 0].tolist()


def test_normalized_and_cross_entropy(spark):
    rows = [(1.0, 5.0, [0.5, 0.5], [1.0, 0.0]), (3.0, 5.0, [0.2, 0.8], [0.0, 1.0]), (8.0, 5.0, [0.9, 0.1], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "x double, c double, p array<double>, t array<double>")
    x = np.array([r[0] for r in rows])
    np.testing.assert_allclose([r.y for r in L.normalized(df, "x", "y").collect()], (x - x.mean()) / x.std())
    assert [r.y for r in L.normalized(df, "c", "y").collect()] == [0.0] * 3
    assert df.agg(L.cross_entropy(F.col("p"), F.col("t"))).first()[0] == pytest.approx(-(np.log(0.5) + np.log(0.8) + np.log(0.9)) / 3)


def test_gaussian_process_expressions():
    from tensorloom.plans import tensor as T

    x, y, at = np.array([-1.0, 0.2, 1.5]), np.array([0.3, -0.5, 0.9]), np.array([-0.4, 0.7])
    kernel = L.squared_exponential(0.8, 1.3)
    mean, cov = L.gp_expressions(3, 2, 0.8, 1.3, 0.01)
    inverse = np.linalg.inv(kernel(x, x) + 0.01 * np.eye(3))
    bind = {"known_x": x, "known_y": y, "at": at}
    np.testing.assert_allclose(mean.value(bind), kernel(at, x) @ inverse @ y)
    np.testing.assert_allclose(cov.value(bind), kernel(at, at) - kernel(at, x) @ inverse @ kernel(x, at), atol=1e-12)
    assert all(d < 1e-5 for d in T.derivative_deviation(mean, bind).values())
    m, c = L.gp_prior(at, kernel, 2.0)
    assert m.tolist() == [2.0, 2.0] and c[0, 0] == 1.3
