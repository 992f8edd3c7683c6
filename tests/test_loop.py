import numpy as np
import pytest

from tensorloom.operators.loop import ITERATION, REMAINING, Channels, previous
from tensorloom.plans import tensor as T
from tensorloom.plans.expr import unary, var, where_greater

PARS = {"a": 0.7, "b": -0.4}
STEPS = {
    "u": unary("tanh", previous("u", 1) * var("a") + previous("v", 3) * 0.5 + var("x") * var("b")) + var(ITERATION) * 0.01,
    "v": previous("u", 2) * previous("v", 1) * 0.3 + where_greater(var("x"), 0, var("x"), 0.1) / (1 + var(REMAINING)),
}
INITIAL = {"u": [0.1, -0.2], "v": [0.5, 0.3, 0.7]}
ROWS = [(s, k, float(np.sin(k * 1.3 + s)), 0.5 + k % 3, float(k % 2)) for s in range(4) for k in range(1 + s * 4)]


def local(pars=PARS, initial=INITIAL, rows=ROWS):
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == s)
        u, v = list(initial["u"]), list(initial["v"])
        for k, (_, at, x, *_) in enumerate(own):
            bind = {**pars, "x": x, ITERATION: k, REMAINING: len(own) - 1 - k, "u@1": u[-1], "u@2": u[-2], "v@1": v[-1], "v@3": v[-3]}
            new = [STEPS[c].value(bind) for c in "uv"]
            u.append(new[0]), v.append(new[1])
            out[s, at] = new
    return out


def total(**changes):
    states = local(**changes)
    rows = changes.get("rows", ROWS)
    return sum(r[3] * states[r[0], r[1]][0] + r[4] * states[r[0], r[1]][1] for r in rows)


def test_channels_and_their_derivatives(spark):
    df = spark.createDataFrame(ROWS, "s long, k long, x double, su double, sv double").repartition(3)
    loop = Channels(STEPS, "s", ["k"], INITIAL)
    want = local()
    for r in loop.states(df, PARS).collect():
        assert (r.u, r.v) == pytest.approx(tuple(want[r.s, r.k]))
    seeds, h = {"u": "su", "v": "sv"}, 1e-6
    found = loop.gradient(df, seeds, PARS)
    for n in PARS:
        assert float(found[n][0] if np.ndim(found[n]) else found[n]) == pytest.approx((total(pars={**PARS, n: PARS[n] + h}) - total(pars={**PARS, n: PARS[n] - h})) / (2 * h), abs=1e-6)
    for c in "uv":
        for j in range(len(INITIAL[c])):
            moved = [{**INITIAL, c: [x + (d if i == j else 0) for i, x in enumerate(INITIAL[c])]} for d in (h, -h)]
            assert found[f"initial_{c}"][j] == pytest.approx((total(initial=moved[0]) - total(initial=moved[1])) / (2 * h), abs=1e-6)
    for r in loop.adjoints(df, seeds, PARS).where("s = 2").collect():
        up, down = ([(s, k, x + d if (s, k) == (r.s, r.k) else x, *w) for s, k, x, *w in ROWS] for d in (h, -h))
        assert r.d_x == pytest.approx((total(rows=up) - total(rows=down)) / (2 * h), abs=1e-6)


def test_tensor_channels(spark):
    rng = np.random.default_rng(1)
    w, xs = rng.normal(size=(2, 2)), rng.normal(size=(12, 2))
    step = T.unary("tanh", T.dot(T.var("w", (2, 2)), previous("h", 1, (2,))) + T.var("x", (2,)))
    rows = [(s, k, xs[6 * s + k].tolist(), [1.0, float(k)]) for s in range(2) for k in range(6)]
    df = spark.createDataFrame(rows, "s long, k long, x array<double>, seed array<double>").repartition(2)
    loop = Channels({"h": step}, "s", ["k"], {"h": [np.array([0.1, 0.2])]})

    def run(w, start=(0.1, 0.2)):
        out = 0.0
        for s in range(2):
            h = np.array(start)
            for k in range(6):
                h = np.tanh(w @ h + xs[6 * s + k])
                out += h @ [1.0, k]
        return out, h

    last = loop.states(df, {"w": w}).where("s = 1 AND k = 5").first()
    np.testing.assert_allclose(last.h, run(w)[1])
    g, d = loop.gradient(df, {"h": "seed"}, {"w": w}), 1e-6
    for i in range(2):
        for j in range(2):
            e = np.zeros((2, 2))
            e[i, j] = d
            assert g["w"][i, j] == pytest.approx((run(w + e)[0] - run(w - e)[0]) / (2 * d), abs=1e-5)
        e = np.eye(2)[i] * d
        assert g["initial_h"][i] == pytest.approx((run(w, np.array([0.1, 0.2]) + e)[0] - run(w, np.array([0.1, 0.2]) - e)[0]) / (2 * d), abs=1e-5)


def test_what_a_loop_refuses(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0)], "s long, k long, x double")
    with pytest.raises(ValueError, match="initial"):
        Channels({"u": previous("u", 2)}, "s", ["k"], {"u": [0.0]}).states(df)
    with pytest.raises(ValueError, match="channel"):
        Channels({"u": previous("z")}, "s", ["k"], {"u": [0.0]}).states(df)
    with pytest.raises(ValueError, match="neither"):
        Channels({"u": var("nowhere")}, "s", ["k"]).states(df)
    with pytest.raises(Exception, match="nulls"):
        Channels({"u": var("x")}, "s", ["k"]).states(df).collect()
    assert Channels({"u": var("x")}, "s", ["k"]).states(df.limit(0)).count() == 0


def test_a_long_sequence_is_streamed(spark):
    """One sequence of a hundred thousand rows: the work grows with the rows."""
    df = spark.range(100_000).selectExpr("1L AS s", "id AS k", "1.0 AS x")
    got = Channels({"u": previous("u") * 0.5 + var("x")}, "s", ["k"], {"u": [0.0]}).states(df).agg({"u": "max"}).first()[0]
    assert got == pytest.approx(2.0)


def test_compiled_expressions_are_ieee():
    x, y = var("x"), var("y")
    run = (x / y).compiled(["x", "y"])
    assert run(1.0, 0.0) == np.inf and np.isnan(run(0.0, 0.0))
    assert np.isnan(unary("log", x).compiled(["x"])(-1.0)) and unary("log", x).compiled(["x"])(0.0) == -np.inf and unary("exp", x).compiled(["x"])(1e4) == np.inf
