import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import learn, model
from tensorloom.operators.dataset import Dataset
from tensorloom.operators.frame import TensorFrame
from tensorloom.plans import tensor as T

RNG = np.random.default_rng(0)
AT = {"a": RNG.normal(size=(3, 4)), "b": RNG.normal(size=(4, 2)), "s": RNG.normal(size=(2, 3, 3)) + 3 * np.eye(3), "w": RNG.uniform(0.5, 2, 3)}
a, b, s, w = (T.var(n, x.shape) for n, x in AT.items())
CASES = {
    "dot": a @ b, "batched": T.dot(s, T.reshape(T.concat([w, w], 0), (2, 3))), "unary": T.unary("tanh", a) * T.unary("sin", a), "broadcast": a * T.insert_axis(w, 1) + 1.0, "power": T.insert_axis(w, 1) ** a,
    "sum": T.total(a, 0), "mean": T.mean(a, 1, True), "product": T.product(a, 1), "largest": T.largest(a, 1), "softmax": T.softmax(a), "invert": T.invert(s), "diag": T.diag(s), "diag_mat": T.diag_mat(a, 0, 1), "trace": T.trace(s),
    "permute": T.permute(s, (1, 2, 0)), "part": T.part(a, (1, 2), (0, 1)), "set_part": T.set_part(a, (1, 1), T.part(b, (0, 1))), "concat": T.concat([a, a * 2.0], 1), "reverse": T.reverse_axis(a, 1),
    "gather": T.gather(a, [T.const([0, 2, 2]), T.const([1, 1, 3])]), "gather_own": T.gather(a, [None, T.const([[1, 3], [0, 0], [2, 2]])]), "scatter": T.scatter(a, [T.const([[0], [1], [0]]), None], (2, 4)),
    "where": T.where(T.binary("greater", a, 0.0), a * a, a), "kronecker": T.tensor_product(a, b), "divide": a / (2.0 + a * a), "sigmoid": T.sigmoid(a), "relu": T.relu(a), "vector": T.dot(w, a), "replicate": T.replicate(a, 0, 2),
    "build": T.build((5, 4), [((0, 0), a), ((3, 2), T.part(a, (0, 1), (0, 1)))]), "least": T.least(a), "column": T.part(a, 1, T.ALL), "part_at": T.part_at(a, [1, T.const(2.0)], (2, 2)),
}


def need(e):
    return {n: AT[n] for n in e.variables()}


@pytest.mark.parametrize("name", CASES)
def test_derivatives_are_central_differences(name):
    e = CASES[name]
    assert e.value(need(e)).shape == e.shape
    assert all(d < 1e-6 for d in T.derivative_deviation(e, need(e)).values())


def test_frames_equal_numpy(spark):
    frames = {n: TensorFrame.of_numpy(spark, x) for n, x in AT.items()}
    for name in ("dot", "softmax", "gather_own", "scatter", "set_part", "where", "invert", "kronecker", "diag_mat"):
        np.testing.assert_allclose(CASES[name].frame(spark, frames).numpy(), CASES[name].value(AT), atol=1e-9, err_msg=name)
    loss = T.total(T.sigmoid(a @ b) ** 2.0)
    for n, g in loss.gradient(["a", "b"]).items():
        np.testing.assert_allclose(g.frame(spark, frames).numpy(), g.value(AT), atol=1e-9, err_msg=n)


def test_expressions():
    assert (a + 1.0) is (a + 1.0) and a * 1.0 is a and (a @ b).contains(a) and (a @ b).count_ops() == 3
    e = (a @ b).subst(a, T.var("c", (3, 4)))
    assert set(e.variables()) == {"c", "b"} and T.size_value(a, 1).value() == 4
    with pytest.raises(ValueError):
        a + b
    with pytest.raises(ValueError):
        (a @ b).gradient(["a"])
    with pytest.raises(IndexError):
        T.part(a, (0, 9))
    assert T.total(T.stop(a) * a).gradient(["a"])["a"].value(need(a)) == pytest.approx(AT["a"])
    doubled = T.assume_jacobian(a, T.identity(12) * 2.0)
    assert doubled.jacobian("a").value(need(a)) == pytest.approx(2 * np.eye(12))
    with pytest.raises(ArithmeticError):
        T.check_finite(a / 0.0).value(need(a))

    class Cube(T.Operation):
        def shape(self, x):
            return x

        def value(self, x):
            return x**3

        def slopes(self, g, x):
            return [g * T.insert_axis(3.0 * x * x, 0)]

    assert T.derivative_deviation(Cube()(a) @ b, {"a": AT["a"], "b": AT["b"]})["a"] < 1e-6


def test_functions():
    said, fixed = [], {"state": np.array([1.0, 2.0])}
    state, x = T.var("state", (2,)), T.var("x", (2,))
    step = T.Function([T.total(T.printed(x, "x")), T.discard(T.store(state + x, "state"))], ["x"], fixed, said.append)
    total, nothing = step(np.array([3.0, 4.0]))
    assert total == 7 and nothing.shape == (0,) and step.fixed["state"].tolist() == [4.0, 6.0] and len(said) == 1
    step(np.array([1.0, 1.0]))
    assert fixed["state"].tolist() == [5.0, 7.0] and step.dumped["x"].tolist() == [1.0, 1.0]
    with pytest.raises(ValueError):
        T.Function(a @ b, ["a"])


@pytest.fixture(scope="module")
def data(spark):
    x = RNG.normal(size=(300, 2))
    kind = ((x**2).sum(1) < 1.2).astype(int)
    rows = [(k, x[k].tolist(), np.eye(2)[kind[k]].tolist()) for k in range(300)]
    return Dataset.of_samples(spark.createDataFrame(rows, "k long, input array<double>, target array<double>").repartition(4), ["k"]).split()


def test_gradient_equals_the_local_one(data):
    net = model.Perceptron(2, (5, 2), ("tanh", "identity"), l2=0.01)
    flat = net.parameters.start(3)
    loss, g = model.loss_and_gradient(net, data["trn"].df, flat, rows=37)
    rows = data["trn"].df.orderBy("sample_id").collect()
    x, y = (np.array([r[c] for r in rows]) for c in ("input", "target"))
    whole = net.loss(len(rows))
    bind = {**net.parameters.unpack(flat), "input": x, "target": y}
    assert loss == pytest.approx(float(whole.value(bind)))
    want = net.parameters.pack({n: d.value(bind) for n, d in whole.gradient(list(net.parameters.shapes)).items()})
    np.testing.assert_allclose(g, want, atol=1e-9)


def test_perceptron_learns_and_resumes(spark, data, tmp_path):
    net = model.Perceptron(2, (8, 2), ("tanh", "identity"))
    plan = model.TrainingPlan(rates=(0.1,), max_iterations=30, log_every=10, checkpoint=str(tmp_path / "c"), checkpoint_every=10)
    trained = model.train(net, data, learn.Adam(), plan)
    assert trained.log[-1][2] < 0.5 * trained.log[0][2] and trained.reason == "iterations used up"
    again = model.train(net, data, learn.Adam(), model.TrainingPlan(rates=(0.1,), max_iterations=10, log_every=10, checkpoint=str(tmp_path / "c")))
    np.testing.assert_allclose(again.flat, trained.flat)  # from iteration 20 on, with the optimiser's state
    found = net.predict(data["tst"].df, trained.flat).select(F.expr("array_position(prediction, array_max(prediction)) = array_position(target, array_max(target))").alias("ok"))
    assert found.where("ok").count() >= 24
    net.parameters.save(spark, trained.flat, str(tmp_path / "p"))
    np.testing.assert_array_equal(net.parameters.load(spark, str(tmp_path / "p")), trained.flat)


def test_stopping(data):
    net = model.Perceptron(2, (2,), ("identity",), "mse")
    batches = model.train(net, data, learn.GradientDescent(), model.TrainingPlan(batch_size=100, rates=(0.05, 0.01), max_iterations=4))
    assert batches.reason == "iterations used up" and [r[0] for r in batches.log] == sorted({r[0] for r in batches.log}) and batches.log[-1][0] == batches.best_iteration
    far = model.train(net, data, learn.GradientDescent(), model.TrainingPlan(rates=(1e200,), max_iterations=6))
    assert far.reason == "not finite" and np.isfinite(far.flat).all()
    assert model.train(net, data, learn.GradientDescent(), model.TrainingPlan(target=1e9)).reason == "target reached"
    assert model.train(net, data, learn.GradientDescent(), model.TrainingPlan(rates=(0.0,), patience=2)).reason == "no improvement"
    best = model.grid_search({"x": [1, 2, 3], "y": [0, 5]}, lambda x, y: abs(x - 2) + y)
    assert best[0] == ({"x": 2, "y": 0}, 0) and len(best) == 6
