import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions.scalar import BINARY, NOT_FOUND, UNARY
from tensorloom.operators.frame import ALL, NEW_AXIS, TensorFrame

RNG = np.random.default_rng(5)
A = RNG.normal(size=(3, 4)).round(3)
C = RNG.normal(size=(2, 3, 4)).round(3)


@pytest.fixture(scope="module")
def t(spark):
    return lambda x: TensorFrame.of_numpy(spark, np.asarray(x))


def same(got, want):
    got = got.numpy() if isinstance(got, TensorFrame) else got
    assert got.shape == np.shape(want), (got.shape, np.shape(want))
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_generators(spark):
    T = TensorFrame
    same(T.zeros(spark, (2, 3)), np.zeros((2, 3)))
    same(T.ones(spark, (4,)), np.ones(4))
    same(T.identity(spark, 3), np.eye(3))
    same(T.counting(spark, 5), np.arange(5))
    same(T.arange(spark, 0, 3, 10), [0, 3, 6])
    same(T.arange(spark, 5, 1, 2), [])
    same(T.linspace(spark, 0, 1, 5), np.linspace(0, 1, 5))
    same(T.scalar(spark, 7.0), 7.0)
    assert T.trues(spark, (2,)).reduce("all").element() and not T.falses(spark, (2,)).reduce("any").element()
    same(T.init(spark, (2, 3, 4), lambda a, b, c: a * 100 + b * 10 + c), np.fromfunction(lambda a, b, c: a * 100 + b * 10 + c, (2, 3, 4)))
    normal = T.random_normal(spark, (10000,), 3.0, 1.5, 124)
    assert abs(normal.mean().element() - 3.0) < 0.06 and abs(normal.reduce("var").element() - 1.5) < 0.09


def test_unary_and_binary(spark):
    x = [0.0, -0.0, 1.5, -2.5, 2.5, 0.5, math.nan, math.inf, -math.inf, 1e300, -7.2]
    frame = spark.createDataFrame([(a, b) for a in x for b in x], "a double, b double")
    names = {"negate": np.negative, "abs": np.abs, "log": np.log, "log10": np.log10, "exp": np.exp, "sin": np.sin, "tanh": np.tanh, "sqrt": np.sqrt, "ceil": np.ceil, "floor": np.floor, "round": np.rint, "truncate": np.trunc, "is_finite": np.isfinite, "asin": np.arcsin, "cosh": np.cosh, "atan": np.arctan}
    table = frame.select("a", *(UNARY[n](F.col("a")).alias(n) for n in names)).distinct().toPandas()
    with np.errstate(all="ignore"):
        for n, f in names.items():
            np.testing.assert_allclose(table[n].to_numpy().astype(float), f(table["a"].to_numpy()).astype(float), rtol=1e-12, err_msg=n)
        names = {"add": np.add, "subtract": np.subtract, "multiply": np.multiply, "divide": np.divide, "modulo": np.fmod, "equal": np.equal, "not_equal": np.not_equal, "less": np.less, "less_or_equal": np.less_equal, "greater": np.greater, "greater_or_equal": np.greater_equal}
        table = frame.select("a", "b", *(BINARY[n](F.col("a"), F.col("b")).alias(n) for n in names)).toPandas()
        for n, f in names.items():
            np.testing.assert_allclose(table[n].to_numpy().astype(float), f(table["a"].to_numpy(), table["b"].to_numpy()).astype(float), rtol=1e-12, err_msg=n)
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    got = frame.select(BINARY["max_elemwise"](F.col("a"), F.col("b")).alias("m")).toPandas()["m"].to_numpy()
    np.testing.assert_array_equal(got, np.where(a > b, a, b))


def test_shapes(t):
    c, a = t(C), t(A)
    same(c.slice(1, (1, 2), ALL), C[1, 1:3])
    same(c.slice(..., NEW_AXIS, 2), C[:, :, None, 2])
    same(a.slice((2, 1), ALL), A[2:2])
    with pytest.raises(IndexError):
        a.slice(3)
    same(a.set_slice([(0, 1), (2, 3)], 9.0), np.where((np.arange(3)[:, None] < 2) & (np.arange(4) > 1), 9.0, A))
    same(a.set_slice([ALL, (1, 1)], t([[1.0], [2.0], [3.0]])), np.column_stack([A[:, 0], [1, 2, 3], A[:, 2:]]))
    same(c.reshape([4, -1]), C.reshape(4, -1))
    same(c.flatten(), C.reshape(-1))
    same(c.transpose(), C.swapaxes(1, 2))
    same(c.permute_axes([1, 2, 0]), C.transpose(2, 0, 1))
    same(c.reverse_axis(2), C[:, :, ::-1])
    same(t(A[:1]).broadcast_to([2, 3, 4]), np.broadcast_to(A[:1], (2, 3, 4)))
    same(a.pad_right().cut_right(), A)
    square = RNG.normal(size=(2, 3, 3))
    same(t(square).diag(), np.einsum("bii->bi", square))
    same(t(square).trace(), np.einsum("bii->b", square))
    same(t(A[0]).diag_mat(), np.diag(A[0]))
    same(TensorFrame.concat(1, [a, a]), np.concatenate([A, A], 1))
    same(TensorFrame.of_blocks([[a, a], [a, a]]), np.block([[A, A], [A, A]]))
    same(a.replicate(0, 3), np.tile(A, (3, 1)))
    same(a.replicate_to(1, 6), np.tile(A, 2)[:, :6])
    same(a.diff_axis(1), np.diff(A))
    same(t(np.array([1.7, -1.7])).convert("bigint"), [1, -1])


def test_broadcasting_and_products(t):
    a, c = t(A), t(C)
    same(c + a, C + A)
    same(a * t(A[:, :1]), A * A[:, :1])
    same(t(A[:, :1]) - t(A[:1]), A[:, :1] - A[:1])
    same(a / 0.0, np.where(A > 0, np.inf, -np.inf))
    same(a.binary("greater", 0.0).if_then_else(a, a * 2.0), np.where(A > 0, A, 2 * A))
    assert a.almost_equal(a + 1e-9) and not a.almost_equal(a + 1.0)
    same(a.dot(a.transpose()), A @ A.T)
    same(a.dot(t(A[0])), A @ A[0])
    same(t(A[0]).dot(t(A[1])), A[0] @ A[1])
    same(c.dot(c.transpose()), C @ C.swapaxes(1, 2))
    same(a.tensor_product(t(A[:2, :2])), np.kron(A, A[:2, :2]))


def test_reductions(t, spark):
    c = t(C)
    for name, f in {"sum": np.sum, "product": np.prod, "min": np.min, "max": np.max, "mean": np.mean, "var": np.var, "std": np.std}.items():
        for axis in (0, 1, 2, None):
            same(c.reduce(name, axis), f(C, axis))
    same(c.reduce("sum", 1, keep=True), C.sum(1, keepdims=True))
    same(c.reduce("var", 0, ddof=1), C.var(0, ddof=1))
    same(c.reduce("norm", 2), np.linalg.norm(C, axis=2))
    same(c.arg("max", 2), C.argmax(2))
    same(c.arg("min", 0), C.argmin(0))
    ties = t(np.array([[2.0, 1.0, 2.0, math.nan], [math.nan, -math.inf, math.nan, -math.inf]]))
    same(ties.arg("max", 1), [0, NOT_FOUND])
    same(ties.reduce("max", 1), [2.0, -1.7976931348623157e308])
    same(ties.find(1.0, 1), [1, NOT_FOUND])
    same(t(np.zeros((0, 3))).sum(0), np.zeros(3))
    same(t(np.zeros((0,))).reduce("product"), 1.0)
    same(t(np.array([[7, 2], [2, 2]])).mean(1), [4, 2])
    mask = C > 0
    same(t(mask).reduce("count_true", 1), mask.sum(1))
    same(t(mask).reduce("all", 2), mask.all(2))
    same(t(mask).reduce("any", 0), mask.any(0))
    same(c.fold_axis(2, F.lit(0.0), lambda s, v: s * 0.5 + v), np.stack([C[..., k] * 0.5 ** (3 - k) for k in range(4)]).sum(0))


def test_masks_gather_scatter(t):
    m = np.arange(18).reshape(2, 9)
    rows, columns = np.array([True, False]), np.array([k % 3 == 1 for k in range(9)])
    same(t(m).masked([t(rows), t(columns)]), m[np.ix_(rows, columns)])
    same(t(m).masked([None, t(columns)]), m[:, columns])
    same(t(m).set_masked(t(m > 9), 0), np.where(m > 9, 0, m))
    both = np.arange(24.0).reshape(2, 3, 4)
    plane = both[:, :, 0] % 8 == 0
    same(t(both).masked([t(plane)]), both[plane])
    same(t(both).masked([None, t(np.arange(12).reshape(3, 4) % 5 == 0)]), both[:, np.arange(12).reshape(3, 4) % 5 == 0])
    with pytest.raises(ValueError):
        t(both).masked([t(np.ones((3, 2), bool))])
    changed = both.copy()
    changed[np.ix_([True, False], [True, False, True])] = [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]]
    same(t(both).set_masked([t(np.array([True, False])), t(np.array([True, False, True]))], t(np.arange(1.0, 9.0).reshape(2, 4))), changed)
    changed[:, :, np.array([True, False, False, True])] = -1.0
    same(t(both).set_masked([t(np.array([True, False])), t(np.array([True, False, True]))], t(np.arange(1.0, 9.0).reshape(2, 4))).set_masked([None, None, t(np.array([True, False, False, True]))], -1.0), changed)
    with pytest.raises(ValueError):
        t(m).set_masked(t(m > 9), t(np.arange(3)))
    filled = m.copy()
    filled[m > 9] = np.arange(8) * 10
    same(t(m).set_masked(t(m > 9), t(np.arange(8) * 10)), filled)
    b = np.array([[True, True, False, True], [False, True, True, True]])
    same(t(b).true_idx(), np.argwhere(b))
    s = np.arange(12.0).reshape(4, 3)
    i, j = np.array([1, 2, 2]), np.array([0, 0, 1])
    same(t(s).gather([t(i), t(j)]), s[i, j])
    index = np.broadcast_to(np.array([1, 2, 0]), (4, 3))
    same(t(s).gather([None, t(index)]), np.take_along_axis(s, index, 1))
    with pytest.raises(Exception, match="out of range"):
        t(s).gather([t(np.array([9])), t(np.array([0]))]).numpy()
    target = np.array([[1, 1, 1], [2, 2, 2], [2, 2, 2], [0, 0, 0]])
    want = np.zeros((3, 3))
    for r in range(4):
        want[target[r, 0]] += s[r]
    same(t(s).scatter([t(target), None], (3, 3)), want)
    same(t(s).scatter([None, None], (5, 3)), np.vstack([s, np.zeros((1, 3))]))
    with pytest.raises(ValueError):
        t(s).gather([t(index), None])


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_numbers_are_dense_whatever_the_partitions(spark, monkeypatch, coalesce):
    """Wide rows over many partitions and buckets, hot keys, nulls: each number once, in order."""
    from tensorloom.operators import frame

    monkeypatch.setattr(frame, "BUCKET_ROWS", 3_000)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        n = 200_000
        wide = spark.range(n, numPartitions=13).select((F.col("id") * 7919 % n).alias("k"), F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 10 != 0, F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("s"), F.repeat(F.lit("x"), 300).alias("w"))
        for order in (["k"], ["s", "k"], ["s"]):
            out, total = frame._numbered(wide, order)
            table = out.select("n", "k", "s").toPandas().sort_values("n")
            assert total == n and (table["n"].to_numpy() == np.arange(n)).all() and table["k"].nunique() == n
            keys = [tuple((x is not None, x) for x in row) for row in table[order].astype(object).where(table[order].notna(), None).itertuples(index=False)]
            assert keys == sorted(keys)
        assert out.select("n").where("n < 0 OR n >= 200000").isEmpty()
        empty, total = frame._numbered(wide.limit(0), ["k"])
        assert total == 0 and empty.count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_differences_over_blocks(t, monkeypatch):
    from tensorloom.operators import frame

    monkeypatch.setattr(frame, "DIFF_BLOCK", 4)
    for n in (1, 4, 5, 8, 9, 30):
        x = RNG.normal(size=n)
        same(t(x).diff(), np.diff(x))
    x = RNG.normal(size=(3, 10, 2))
    same(t(x).diff_axis(1), np.diff(x, axis=1))


def test_tiles_equal_plain_products(t, monkeypatch):
    from tensorloom.operators import frame

    monkeypatch.setattr(frame, "TILED_PRODUCTS", 0)
    monkeypatch.setattr(frame, "TILE", 3)
    for x, y in (((7, 10), (10, 5)), ((2, 4, 7), (2, 7, 3)), ((1, 20), (20, 1)), ((3, 3), (3, 3))):
        a, b = RNG.normal(size=x), RNG.normal(size=y)
        same(t(a).dot(t(b)), a @ b)
    a = RNG.normal(size=(4, 6))
    same(t(a).dot_trace(t(a.T)), np.trace(a @ a.T))


def test_integers_as_in_fixed_width(t, spark):
    big = np.array([[2**63 - 1, -(2**63), 3], [5, -7, 2**62]])
    other = np.array([[1, -1, -2], [2, 2, 5]])
    with np.errstate(over="ignore"):
        for name, f in {"add": np.add, "subtract": np.subtract, "multiply": np.multiply}.items():
            same(t(big).binary(name, t(other)), f(big, other))
        same(-t(big), -big)
        for axis in (0, 1):
            same(t(big).reduce("sum", axis), big.sum(axis))
            same(t(big).reduce("product", axis), big.prod(axis))
            same(t(big).reduce("max", axis), big.max(axis))
            same(t(big).reduce("min", axis), big.min(axis))
        small = t(np.array([100, -7, 7], np.int32)).convert("tinyint")
        assert (small + small).to_list() == [-56, -14, 14] and (small + small).dtype == "tinyint"
        many = RNG.integers(-9, 9, 3000) * 2 + 1
        same(t(many).reduce("product"), many.prod())
    same(t(np.array([7, -7, 7])) / t(np.array([2, 2, -2])), [3, -3, -3])
    same(t(np.array([7, -7, 7])) % t(np.array([2, 2, -2])), [1, -1, 1])
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        (t(np.array([1])) / t(np.array([0]))).numpy()
    a, b = np.array([2**53, 2**53 + 1, 100000]), np.array([2**53 + 1, 2**53 + 1, 100001])
    assert t(a).is_close(t(b)).to_list() == [False, True, False] and not t(a).almost_equal(t(b))
    assert t(a).arg_all("max") == [1] and t(big).arg_all("min") == [0, 1] and t(big).arg("max", 1).to_list() == [0, 2]
    assert t(np.full(3, -(2**63))).arg("max", 0).element() == NOT_FOUND and t(np.full(3, -(2**63))).reduce("max").element() == -(2**63)
    empty = spark.createDataFrame([], "i0 long, v smallint")
    assert TensorFrame(empty, (0,)).reduce("max").element() == -(2**15) and TensorFrame(empty, (0,)).reduce("min").element() == 2**15 - 1
    assert t(np.array([1.9, -1.9, math.nan, 1e30, 300.0])).convert("int").to_list() == [1, -1, -(2**31), -(2**31), 300]
    assert t(np.array([300, -129, 2**40 + 5])).convert("tinyint").to_list() == [44, 127, 5]
    assert not t(np.array([1.0, math.inf])).all_finite() and t(big).all_finite()


def test_searches(t):
    x = np.array([[1.0, math.nan, 5.0], [5.0, -math.inf, 1.0]])
    assert t(x).find_all(5.0) == [0, 2] and t(x).try_find(math.nan) is None and t(x).find(math.nan, 1).to_list() == [NOT_FOUND] * 2
    assert t(x).arg_all("max") == [0, 2] and t(x).arg_all("min") == [1, 1]
    with pytest.raises(LookupError):
        t(x).find_all(7.0)
    with pytest.raises(ValueError):
        t(np.array([math.nan])).arg_all("max")
    assert t(x).try_reshape([4, 2]) is None and t(x).try_reshape([3, -1]).shape == (3, 2)
    assert t(x).linear_to_idx(4) == [1, 1] and t(x).idx_to_linear([1, 1]) == 4
    same(t(np.arange(4.0)).set_element([2], 9.0), [0, 1, 9, 3])


def test_more_shapes(t, spark):
    from tensorloom.operators.frame import broadcast_to_same, covariance_matrix

    c = t(C)
    same(c.trace_axis(0, 0) if False else t(C[:, :2, :2]).trace_axis(0, 1), np.einsum("iij->j", C[:, :2, :2]))
    want = np.zeros((2, 3, 2, 4))
    for k in range(2):
        want[k, :, k] = C[k]
    same(c.diag_mat_axis(0, 2), want)
    same(c.mapi2(t(A), lambda i, j, k, a, b: a * b + i * 100 + j * 10 + k), C * A + np.fromfunction(lambda i, j, k: i * 100 + j * 10 + k, C.shape))
    x, y, z = broadcast_to_same(t(A[:, :1]), t(A[:1]), t(C))
    assert x.shape == y.shape == z.shape == C.shape
    same(x, np.broadcast_to(A[:, :1], C.shape))
    x, y = broadcast_to_same(t(A[:, :1]), t(A[:1]), dims=[0])
    assert (x.shape, y.shape) == ((3, 1), (3, 4))
    same(TensorFrame.of_seq(spark, iter(range(100)), (2, 3)), np.arange(6).reshape(2, 3))
    assert list(t(np.array([[1.5, 2.5]])).elements()) == [((0, 0), 1.5), ((0, 1), 2.5)]
    assert "beginning" in t(np.zeros((3, 20))).pretty() and "double[3, 4]" in t(A).pretty()
    same(covariance_matrix(lambda a, b: a * b, t(A[0]), t(A[1])), np.outer(A[0], A[1]))
    table = t(A).summary(["sum", "max", "arg_max", "std"], 1).orderBy("i0").toPandas()
    np.testing.assert_allclose(table[["sum", "max", "arg_max", "std"]], np.stack([A.sum(1), A.max(1), A.argmax(1), A.std(1)], 1))
