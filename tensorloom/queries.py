"""Queries over the driver tables, one or more per operator family, each with the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions import rational, scalar
from tensorloom.functions.scalar import BINARY, UNARY, cage, is_close, normal_pdf, relu, sigmoid
from tensorloom.operators import dataset, learn, linalg, model, scan, textmodel
from tensorloom.operators.frame import ALL, TensorFrame, covariance_matrix
from tensorloom.operators.loop import ITERATION, Channels, Loop, previous
from tensorloom.plans import elements, expr
from tensorloom.plans import tensor as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WIDTH = 64

#: SQL for the embeddings as (i0, i1, v).
_E = "e AS (SELECT CAST(vec_id AS BIGINT) AS i0, unnest(range(len(embedding))) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _matrix(spark: SparkSession, sf_dir: str) -> TensorFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return TensorFrame.of_rows(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("a")), "vec_id", "a", (rows.count(), WIDTH))


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + 0.0


def _out(t: TensorFrame, digits: int | None = 6) -> DataFrame:
    return t.df.withColumn("v", _r(F.col("v"), digits)) if digits is not None else t.df


# -- the flagship ------------------------------------------------------------------------------------------------------
@query(f"""WITH {_E}, s AS (SELECT i1, avg(v) AS m, stddev_pop(v) AS d FROM e GROUP BY i1),
    z AS (SELECT i0, i1, (v - m) / (d + 1e-5) AS z FROM e JOIN s USING (i1))
    SELECT i0, arg_min(i1, struct_pack(a := -z, b := i1)) AS axis, round(max(z), 6) + 0.0 AS z FROM z GROUP BY i0""")
def standardize_argmax(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    z = (x - x.reduce("mean", 0)) / (x.reduce("std", 0) + 1e-5)
    return z.summary(["arg_max", "max"], 1).select("i0", F.col("arg_max").alias("axis"), _r(F.col("max")).alias("z"))


# -- generators --------------------------------------------------------------------------------------------------------
@query("""SELECT 'identity' AS kind, a.i * 4 + b.i AS at, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END AS v FROM range(4) a(i), range(4) b(i)
    UNION ALL SELECT 'arange', i, 3.0 * i FROM range(3) t(i) UNION ALL SELECT 'linspace', i, 0.25 * i FROM range(5) t(i)
    UNION ALL SELECT 'counting', i, i FROM range(6) t(i) UNION ALL SELECT 'filled', i, 2.5 FROM range(6) t(i)""")
def generators(spark, sf_dir):
    T = TensorFrame
    made = {"identity": T.identity(spark, 4), "arange": T.arange(spark, 0.0, 3.0, 10.0), "linspace": T.linspace(spark, 0, 1, 5), "counting": T.counting(spark, 6), "filled": T.filled(spark, (2, 3), 2.5)}
    frames = [t.flatten().df.select(F.lit(k).alias("kind"), F.col("i0").alias("at"), F.col("v").cast("double").alias("v")) for k, t in made.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# -- elementwise -------------------------------------------------------------------------------------------------------
_X = "o_totalprice / 100000 - 1.5"
_UNARY_SQL = {
    "negate": "-x", "abs": "abs(x)", "sgn": "CAST(sign(x) AS DOUBLE)", "exp": "exp(x)", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "atan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)",
    "tanh": "tanh(x)", "ceil": "ceil(x)", "floor": "floor(x)", "truncate": "trunc(x)",
}


@query(f"SELECT o_orderkey, {', '.join(f'round({s}, 8) + 0.0 AS {n}' for n, s in _UNARY_SQL.items())}, round(ln(abs(x) + 0.5), 8) + 0.0 AS log, round(log10(abs(x) + 0.5), 8) + 0.0 AS log10, round(sqrt(abs(x)), 8) AS sqrt, round(asin(x / 10), 8) + 0.0 AS asin, round(acos(x / 10), 8) + 0.0 AS acos, isfinite(x) AS is_finite, round_even(x * 2, 0) + 0.0 AS round FROM (SELECT o_orderkey, {_X} AS x FROM orders)")
def elem_unary(spark, sf_dir):
    x = F.expr(_X)
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"))
    x = F.col("x")
    more = {"log": F.abs(x) + 0.5, "log10": F.abs(x) + 0.5, "sqrt": F.abs(x), "asin": x / 10, "acos": x / 10}
    return rows.select("o_orderkey", *(_r(UNARY[n](x), 8).alias(n) for n in _UNARY_SQL), *(_r(UNARY[n](a), 8).alias(n) for n, a in more.items()), UNARY["is_finite"](x).alias("is_finite"), (UNARY["round"](x * 2) + 0.0).alias("round"))


@query("""SELECT l_orderkey, l_linenumber, round(a + b, 6) AS add, round(a - b, 6) + 0.0 AS subtract, round(a * b, 6) AS multiply, CASE WHEN b = 0 THEN NULL ELSE round(a / b, 6) END AS divide,
    b = 0 AND isinf(a / b) AS divide_inf, round(fmod(a, 7), 6) AS modulo, round(pow(b, 2), 6) AS power, greatest(a, b * 500) AS max_elemwise, least(a, b * 500) AS min_elemwise
    FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b FROM lineitem)""")
def elem_binary(spark, sf_dir):
    a, b = F.col("l_quantity"), F.col("l_discount")
    quotient = BINARY["divide"](a, b)
    values = {"add": _r(BINARY["add"](a, b)), "subtract": _r(BINARY["subtract"](a, b)), "multiply": _r(BINARY["multiply"](a, b)), "divide": F.when(b != 0, F.round(quotient, 6)), "divide_inf": (b == 0) & (quotient == float("inf")), "modulo": _r(BINARY["modulo"](a, F.lit(7.0))), "power": _r(BINARY["power"](b, F.lit(2.0))), "max_elemwise": BINARY["max_elemwise"](a, b * 500), "min_elemwise": BINARY["min_elemwise"](a, b * 500)}
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in values.items()))


@query("""SELECT l_orderkey, l_linenumber, a = b AS equal, a <> b AS not_equal, a < b AS less, a <= b AS less_or_equal, a > b AS greater, a >= b AS greater_or_equal,
    (a > b) AND (a > 0.05) AS "and", (a > b) OR (a > 0.05) AS "or", (a > b) <> (a > 0.05) AS "xor", NOT (a > b) AS "not", abs(a - b) <= 1e-8 + 1e-5 * abs(b) AS is_close,
    CASE WHEN a > b THEN a ELSE -b END AS if_then_else, least(greatest(a, 0.02), 0.06) AS cage FROM (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b FROM lineitem)""")
def compare_logic(spark, sf_dir):
    a, b = F.col("l_discount"), F.col("l_tax")
    p, q = BINARY["greater"](a, b), BINARY["greater"](a, F.lit(0.05))
    comparisons = ("equal", "not_equal", "less", "less_or_equal", "greater", "greater_or_equal")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(BINARY[n](a, b).alias(n) for n in comparisons), *(BINARY[n](p, q).alias(n) for n in ("and", "or", "xor")), UNARY["not"](p).alias("not"), is_close(a, b).alias("is_close"), F.when(p, a).otherwise(-b).alias("if_then_else"), cage(a, 0.02, 0.06).alias("cage"))


@query(f"SELECT o_orderkey, round((tanh(x / 2) + 1) / 2, 6) AS sigmoid, greatest(x, 0.0) AS relu, round(exp(-power(x - 0.5, 2) / 4) / sqrt(2 * pi() * 2), 6) AS pdf FROM (SELECT o_orderkey, {_X} AS x FROM orders)")
def activations(spark, sf_dir):
    x = F.expr(_X)
    return _table(spark, sf_dir, "orders").select("o_orderkey", _r(sigmoid(x)).alias("sigmoid"), relu(x).alias("relu"), _r(normal_pdf(x, 0.5, 2.0)).alias("pdf"))


@query(f"WITH {_E}, m AS (SELECT i1, avg(v) AS m FROM e GROUP BY i1) SELECT i0, i1, round(v - m, 6) + 0.0 AS v FROM e JOIN m USING (i1)")
def broadcast_subtract(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _out(x - x.reduce("mean", 0, keep=True))


# -- reductions --------------------------------------------------------------------------------------------------------
def _reductions(axis: int, key: str) -> str:
    return f"WITH {_E} SELECT {key} AS i0, round(sum(v), 6) + 0.0 AS sum, min(v) AS min, max(v) AS max, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) AS var, round(stddev_pop(v), 6) AS std, round(sqrt(sum(v * v)), 6) AS norm FROM e GROUP BY {key}"


def _reduced(x: TensorFrame, axis: int) -> DataFrame:
    names = ("sum", "min", "max", "mean", "var", "std", "norm")
    return x.summary(names, axis).select("i0", *(F.col(n) if n in ("min", "max") else _r(F.col(n)).alias(n) for n in names))


@query(_reductions(0, "i1"))
def reduce_axis0(spark, sf_dir):
    return _reduced(_matrix(spark, sf_dir), 0)


@query(_reductions(1, "i0"))
def reduce_axis1(spark, sf_dir):
    return _reduced(_matrix(spark, sf_dir), 1)


@query(f"WITH {_E} SELECT round(sum(v), 5) + 0.0 AS sum, max(v) AS max, round(stddev_samp(v), 6) AS std1 FROM e")
def reduce_all(spark, sf_dir):
    out = _matrix(spark, sf_dir).summary(["sum", "max", "std"], ddof=1)
    return out.select(_r(F.col("sum"), 5).alias("sum"), "max", _r(F.col("std")).alias("std1"))


@query(f"WITH {_E} SELECT i0, round(product(1 + v / 10), 6) AS v FROM e GROUP BY i0")
def product_axis(spark, sf_dir):
    return _out(_matrix(spark, sf_dir).map(lambda v: 1 + v / 10).reduce("product", 1))


@query(f"WITH {_E} SELECT i0, arg_min(i1, struct_pack(a := v, b := i1)) AS least, arg_min(i1, struct_pack(a := -v, b := i1)) AS most FROM e GROUP BY i0")
def arg_axis(spark, sf_dir):
    return _matrix(spark, sf_dir).summary(["arg_min", "arg_max"], 1).select("i0", F.col("arg_min").alias("least"), F.col("arg_max").alias("most"))


@query(f"WITH {_E} SELECT i0, coalesce(min(CASE WHEN floor(v * 4) = 1 THEN i1 END), -9223372036854775804) AS v FROM e GROUP BY i0")
def find_axis(spark, sf_dir):
    return _matrix(spark, sf_dir).map(lambda v: F.floor(v * 4).cast("double")).find(1.0, 1).df


@query(f"WITH {_E} SELECT i1 AS i0, CAST(count_if(v > 0) AS BIGINT) AS trues, bool_and(v > -0.4) AS every, bool_or(v > 0.4) AS some FROM e GROUP BY i1")
def count_true_all_any(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    parts = {"trues": x.map(lambda v: v > 0).reduce("count_true", 0), "every": x.map(lambda v: v > -0.4).reduce("all", 0), "some": x.map(lambda v: v > 0.4).reduce("any", 0)}
    out = None
    for n, t in parts.items():
        one = t.df.withColumnRenamed("v", n)
        out = one if out is None else out.join(F.broadcast(one), "i0")  # a row for each of the 64 columns
    return out


@query(f"WITH {_E} SELECT i0, round(sum(v * pow(0.5, 63 - i1)), 6) + 0.0 AS v FROM e GROUP BY i0")
def fold_axis(spark, sf_dir):
    return _out(_matrix(spark, sf_dir).fold_axis(1, F.lit(0.0), lambda s, v: s * 0.5 + v))


# -- shape -------------------------------------------------------------------------------------------------------------
@query(f"WITH {_E} SELECT i1 AS i0, 7 - (i0 - 10) AS i1, v FROM e WHERE i0 BETWEEN 10 AND 17")
def slice_transpose_reverse(spark, sf_dir):
    return _matrix(spark, sf_dir).slice((10, 17), ALL).transpose().reverse_axis(1).df


@query(f"WITH {_E} SELECT (i1 // 8) AS i0, i0 AS i1, i1 % 8 AS i2, v FROM e")
def reshape_permute(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return x.reshape([x.shape[0], 8, -1]).permute_axes([1, 0, 2]).df


@query(f"WITH {_E} SELECT i0, i1, CASE WHEN i0 BETWEEN 2 AND 5 AND i1 < 32 THEN i1 * 0.5 WHEN i1 = 63 THEN 0.0 ELSE v END AS v FROM e")
def set_slice(spark, sf_dir):
    """A tensor that broadcasts to a block of rows, and a number in the last column of every row."""
    x, ramp = _matrix(spark, sf_dir), TensorFrame.linspace(spark, 0.0, 15.5, 32)
    return x.set_slice([(2, 5), (0, 31)], ramp).set_slice([ALL, (63, 63)], 0.0).df


@query(f"WITH {_E}, n AS (SELECT count(*) AS n FROM embeddings) SELECT i0, i1, v FROM e UNION ALL SELECT i0 + n, i1, -v FROM e, n")
def concat(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return TensorFrame.concat(0, [x, -x]).df


@query(f"WITH {_E} SELECT i0, r * 64 + i1 AS i1, v FROM e, range(2) t(r)")
def replicate(spark, sf_dir):
    return _matrix(spark, sf_dir).replicate(1, 2).df


@query(f"WITH {_E} SELECT i0, i1 - 1 AS i1, round(v - w, 6) + 0.0 AS v FROM (SELECT i0, i1, v, lag(v) OVER (PARTITION BY i0 ORDER BY i1) AS w FROM e) WHERE w IS NOT NULL")
def diff_axis(spark, sf_dir):
    return _out(_matrix(spark, sf_dir).diff_axis(1))


@query(f"WITH {_E}, f AS (SELECT i0 * 64 + i1 AS k, v FROM e) SELECT a.k AS i0, round(b.v - a.v, 6) + 0.0 AS v FROM f a JOIN f b ON b.k = a.k + 1")
def diff_flat(spark, sf_dir):
    """Differences along one long vector of all elements."""
    return _out(_matrix(spark, sf_dir).flatten().diff())


@query(f"WITH {_E} SELECT i0, i1, CAST(c AS BIGINT) AS i2, CASE WHEN i1 = c THEN v ELSE 0.0 END AS v FROM e, range(64) t(c)")
def diag_mat(spark, sf_dir):
    """Every row on the diagonal of its own matrix."""
    return _matrix(spark, sf_dir).diag_mat().df


@query(f"WITH {_E} SELECT i0, i1 // 9 AS i1, v FROM e WHERE i1 % 9 = 0")
def diag(spark, sf_dir):
    """The diagonals of the rows as matrices of 8 by 8."""
    x = _matrix(spark, sf_dir)
    return x.reshape([x.shape[0], 8, 8]).diag().df


@query(f"WITH {_E} SELECT i0, round(sum(v), 6) + 0.0 AS v FROM e WHERE i1 % 9 = 0 GROUP BY i0")
def trace_batched(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _out(x.reshape([x.shape[0], 8, 8]).trace())


@query(f"WITH {_E} SELECT i0, CAST(0 AS BIGINT) AS i1, i1 AS i2, v FROM e WHERE i1 < 48 UNION ALL SELECT i0, 1, i1 - 16, v FROM e WHERE i1 >= 16")
def concat_blocks(spark, sf_dir):
    """Two overlapping parts of every row, put together as blocks along a new axis."""
    x = _matrix(spark, sf_dir)
    return TensorFrame.concat(1, [x.slice(ALL, (0, 47)).insert_axis(1), x.slice(ALL, (16, 63)).insert_axis(1)]).df


# -- masks, gather, scatter ----------------------------------------------------------------------------------------------
@query(f"WITH {_E}, k AS (SELECT i0, row_number() OVER (ORDER BY i0) - 1 AS n FROM e WHERE i1 = 0 AND v > 0) SELECT n AS i0, i1, v FROM e JOIN k USING (i0)")
def mask_get(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return x.masked([x.slice(ALL, 0).map(lambda v: v > 0), None]).df


@query(f"WITH {_E} SELECT i0, i1, CASE WHEN v < 0 THEN -1.0 ELSE v END AS v FROM e")
def mask_set(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return x.set_masked(x.map(lambda v: v < 0), -1.0).df


@query(f"WITH {_E}, k AS (SELECT i0, i1, row_number() OVER (ORDER BY i0, i1) - 1 AS n FROM e WHERE v > 0.2) SELECT n AS i0, v FROM k JOIN e USING (i0, i1)")
def mask_get_matrix(spark, sf_dir):
    """One mask over both axes."""
    x = _matrix(spark, sf_dir)
    return x.masked([x.map(lambda v: v > 0.2)]).df


@query(f"WITH {_E}, k AS (SELECT i0, i1, row_number() OVER (ORDER BY i0, i1) - 1 AS n FROM e WHERE v > 0.2) SELECT e.i0, e.i1, CASE WHEN n IS NULL THEN v ELSE n * 0.5 END AS v FROM e LEFT JOIN k USING (i0, i1)")
def mask_set_vector(spark, sf_dir):
    """Masked elements replaced by a vector, in row-major order."""
    x = _matrix(spark, sf_dir)
    mask = x.map(lambda v: v > 0.2)
    n = mask.reduce("count_true").element()
    return x.set_masked(mask, TensorFrame.init(spark, (n,), lambda i: i * 0.5)).df


@query(f"WITH {_E}, k AS (SELECT i0 FROM e WHERE i1 = 0 AND v > 0) SELECT e.i0, e.i1, CASE WHEN k.i0 IS NOT NULL AND i1 % 2 = 0 THEN -1.0 ELSE v END AS v FROM e LEFT JOIN k USING (i0)")
def mask_set_axes(spark, sf_dir):
    """Masks of both axes: some rows by every second column."""
    x = _matrix(spark, sf_dir)
    rows, columns = x.slice(ALL, 0).map(lambda v: v > 0), TensorFrame.init(spark, (WIDTH,), lambda i: i % 2 == 0)
    return x.set_masked([rows, columns], -1.0).df


@query(f"WITH {_E}, k AS (SELECT i0, i1, row_number() OVER (ORDER BY i0, i1) - 1 AS n FROM e WHERE v > 0.3) SELECT n AS i0, CAST(0 AS BIGINT) AS i1, i0 AS v FROM k UNION ALL SELECT n, 1, i1 FROM k")
def true_idx(spark, sf_dir):
    return _matrix(spark, sf_dir).map(lambda v: v > 0.3).true_idx().df


def _first_seen(spark, sf_dir) -> tuple[TensorFrame, TensorFrame, int, int]:
    """Order customers as an index vector and customers' balances as a vector."""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    keys, n, m = orders.select((F.col("o_orderkey")).alias("k"), F.col("o_custkey").alias("c")), orders.count(), customers.agg(F.max("c_custkey") + 1).first()[0]
    from tensorloom.operators.frame import _numbered

    index = TensorFrame(_numbered(keys, ["k"])[0].select(F.col("n").alias("i0"), F.col("c").cast("long").alias("v")), (n,))
    return index, TensorFrame(customers.select(F.col("c_custkey").cast("long").alias("i0"), F.col("c_acctbal").alias("v")), (m,)), n, m


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, c_acctbal AS v FROM orders JOIN customer ON o_custkey = c_custkey")
def gather(spark, sf_dir):
    index, balances, _, _ = _first_seen(spark, sf_dir)
    return balances.gather([index]).df


@query("""WITH m AS (SELECT max(c_custkey) + 1 AS m FROM customer), s AS (SELECT o_custkey AS i0, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT CAST(r.i AS BIGINT) AS i0, round(coalesce(s.v, 0), 4) AS v FROM (SELECT unnest(range(m)) AS i FROM m) r LEFT JOIN s ON s.i0 = r.i""")
def scatter(spark, sf_dir):
    index, _, n, m = _first_seen(spark, sf_dir)
    from tensorloom.operators.frame import _numbered

    prices = TensorFrame(_numbered(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])[0].select(F.col("n").alias("i0"), F.col("o_totalprice").alias("v")), (n,))
    return _out(prices.scatter([index], (m,)), 4)


# -- products ----------------------------------------------------------------------------------------------------------
@query(f"WITH {_E} SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v * b.v), 5) + 0.0 AS v FROM e a JOIN e b USING (i0) GROUP BY 1, 2")
def dot_gram(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _out(x.transpose().dot(x), 5)


@query(f"WITH {_E} SELECT a.i0, round(sum(a.v * b.v), 6) + 0.0 AS v FROM e a JOIN (SELECT * FROM e WHERE i0 = 0) b USING (i1) GROUP BY a.i0")
def dot_vector(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _out(x.dot(x.slice(0)))


@query(f"""WITH {_E}, n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT i0, i1, v FROM e UNION ALL
        SELECT i, c, 0.0 FROM n, range(10) k(d), range(64) u(c), LATERAL (SELECT n + d AS i) WHERE i < 10 * CAST(ceil(n / 10) AS BIGINT)),
    r AS (SELECT i0 // 10 AS b, i0 % 10 AS r, i1 AS c, v FROM p)
    SELECT x.b AS i0, x.r AS i1, y.r AS i2, round(sum(x.v * y.v), 6) + 0.0 AS v FROM r x JOIN r y ON x.b = y.b AND x.c = y.c GROUP BY 1, 2, 3""")
def dot_batched(spark, sf_dir):
    """Batches of ten rows times themselves; rows of zeros fill the last batch."""
    x = _matrix(spark, sf_dir)
    if x.shape[0] % 10:
        x = TensorFrame.concat(0, [x, TensorFrame.filled(spark, (-x.shape[0] % 10, WIDTH), 0.0)])
    x = x.reshape([x.shape[0] // 10, 10, WIDTH])
    return _out(x.dot(x.transpose()))


@query(f"WITH {_E} SELECT a.i0 * 3 + b.i0 AS i0, a.i1 * 4 + b.i1 AS i1, round(a.v * b.v, 6) + 0.0 AS v FROM e a, e b WHERE b.i0 < 3 AND b.i1 < 4")
def tensor_product(spark, sf_dir):
    """The whole matrix by a fixed block of 3 x 4, so that the result grows with the rows alone."""
    x = _matrix(spark, sf_dir)
    return _out(x.tensor_product(x.slice((0, 2), (0, 3))))


@query(f"WITH {_E} SELECT round(sum(v * v), 4) AS v FROM e")
def trace(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _out(x.transpose().dot_trace(x), 4)


@query(f"WITH {_E}, w AS (SELECT i0, i1, v FROM e WHERE i0 < 8) SELECT a.i0, b.i0 AS i1, round(sum(a.v * b.v), 6) + 0.0 AS v FROM e a JOIN w b USING (i1) GROUP BY 1, 2")
def elements_contract(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _out(scan.contract("ij,kj->ik", x, x.slice((0, 7), ALL)))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i0, s_acctbal / 1000 AS x FROM supplier), b AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i1, n_nationkey / 2.5 AS y FROM nation)
    SELECT i0, i1, round(1.5 * exp(-power(x - y, 2) / 2), 6) AS v FROM a, b""")
def covariance(spark, sf_dir):
    """A squared-exponential kernel between the balances of all suppliers and a point for each nation."""
    a = dataset.Dataset.of_samples(_table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("v")), ["s_suppkey"])
    b = dataset.Dataset.of_samples(_table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 2.5).alias("v")), ["n_nationkey"])
    x, y = (TensorFrame(d.df.withColumnRenamed("sample_id", "i0"), (d.n_samples,)) for d in (a, b))
    return _out(covariance_matrix(lambda p, q: 1.5 * F.exp(-(p - q) * (p - q) / 2), x, y))


# -- datasets ----------------------------------------------------------------------------------------------------------
def _orders(spark, sf_dir) -> dataset.Dataset:
    return dataset.Dataset.of_samples(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


_ORDERS = "o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS sample_id, o_orderkey, o_totalprice FROM orders), c AS (SELECT count(*) AS n FROM orders)"


@query(f"WITH {_ORDERS} SELECT sample_id // 64 AS batch_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o GROUP BY 1")
def batches(spark, sf_dir):
    return _orders(spark, sf_dir).batches(64).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {_ORDERS}, p AS (SELECT b * 64 + k AS sample_id FROM c, range(64) t(k), LATERAL (SELECT unnest(range(CAST(ceil(n / 64) AS BIGINT))) AS b))
    SELECT p.sample_id // 64 AS batch_id, count(*) AS n, round(sum(coalesce(o_totalprice, 0)), 2) AS total, min(coalesce(o_orderkey, 0)) AS least FROM p LEFT JOIN o USING (sample_id) GROUP BY 1""")
def padded_batches(spark, sf_dir):
    return _orders(spark, sf_dir).padded_batches(64).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("least"))


@query(f"WITH {_ORDERS} SELECT CASE WHEN sample_id < floor(0.8 * n) THEN 'trn' WHEN sample_id < floor(0.8 * n) + floor(0.1 * n) THEN 'val' ELSE 'tst' END AS part, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM o, c GROUP BY 1")
def partition_split(spark, sf_dir):
    out = None
    for name, part in _orders(spark, sf_dir).split().items():
        one = part.df.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _sequences(spark, sf_dir) -> dataset.Dataset:
    return dataset.Dataset.of_sequences(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"])


_RAGGED = "u AS (SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value FROM events)"


@query(f"WITH {_RAGGED} SELECT sample_id // 16 AS batch_id, step // 8 AS slot_id, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM u GROUP BY 1, 2")
def slot_batches(spark, sf_dir):
    """Tiles of 16 sequences by 8 steps, with every step of every sequence."""
    return _sequences(spark, sf_dir).slot_batches(16, 8).groupBy("batch_id", "slot_id").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("value"), 4).alias("total"))


@query(f"WITH {_RAGGED}, t AS (SELECT sample_id AS s, step // 7 AS cut, sum(value) AS total FROM u GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY s, cut) - 1 AS sample_id, CAST(7 AS BIGINT) AS n, round(total, 4) + 0.0 AS total FROM t")
def cut_sequences(spark, sf_dir):
    """Chunks of 7 steps of every sequence, the last one filled up; chunks are numbered through."""
    return _sequences(spark, sf_dir).cut_sequences(7).df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("value"), 4).alias("total"))


@query("WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) + 1e-5 AS d, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 5) + 0.0 AS standard, round((l_extendedprice - lo) / (hi - lo), 6) AS rescaled FROM lineitem, s")
def normalize(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("standard"), F.col("l_extendedprice").alias("rescaled"))
    scaled = dataset.Rescaling().fit(rows, ["rescaled"]).transform(dataset.Standardization().fit(rows, ["standard"]).transform(rows))
    return scaled.withColumns({"standard": _r(F.col("standard"), 5), "rescaled": _r(F.col("rescaled"))})


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (sqrt(l_quantity * l_quantity + l_discount * l_discount) + 1e-5), 6) AS a, round(l_discount / (sqrt(l_quantity * l_quantity + l_discount * l_discount) + 1e-5), 6) AS b FROM lineitem")
def unit_length(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return dataset.unit_length(rows, ["a", "b"]).withColumns({"a": _r(F.col("a")), "b": _r(F.col("b"))})


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS id, (SELECT count(DISTINCT p_brand) FROM part) AS width FROM part")
def categories(spark, sf_dir):
    """Category ids in string order and the width of their one-hot code."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.array("p_brand").alias("cells"))
    columns = dataset.infer_columns(part)
    coded = part.select("p_partkey", (F.array_position(F.array(*map(F.lit, columns[0].categories)), F.col("cells")[0]) - 1).alias("id"))
    return coded.withColumn("width", F.lit(len(columns[0].categories)).cast("long"))


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_discount - 0.02) * 100 AS p FROM lineitem), q AS (SELECT *, least(greatest(p, 0), 5) AS h FROM p)
    SELECT k, n, round(power(floor(h), 2) + (h - floor(h)) * (2 * floor(h) + 1), 5) + 0.0 AS near, CASE WHEN p >= 0 AND p < 5 THEN round(power(floor(p), 2) + (p - floor(p)) * (2 * floor(p) + 1), 5) + 0.0 ELSE 0.0 END AS zero,
           CASE WHEN p >= 0 AND p < 5 THEN round(100 * (2 * floor(p) + 1), 4) ELSE 0.0 END AS slope FROM q WHERE abs(p - round(p, 0)) > 1e-6 OR p < -1e-6 OR p > 5 + 1e-6""")
def interpolate(spark, sf_dir):
    """Squares of 0..5 over [0.02, 0.07], linearly, with the nearest edge or zero outside, and the slope; discounts that fall
    exactly on a point are left out, as rounding decides there on which side they are."""
    table = np.arange(6.0) ** 2
    near, zero = scan.Interpolator(table, [0.0], [5.0]), scan.Interpolator(table, [0.0], [5.0], "zero")
    p = (F.col("l_discount") - 0.02) * 100
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), p.alias("p"))
    rows = rows.where((F.abs(F.col("p") - F.round("p")) > 1e-6) | (F.col("p") < -1e-6) | (F.col("p") > 5 + 1e-6))
    return rows.select("k", "n", _r(near(F.col("p")), 5).alias("near"), _r(zero(F.col("p")), 5).alias("zero"), F.round(near.derivative(0)(F.col("p")) * 100, 4).alias("slope"))


@query("SELECT event_id, round(sum(value / 3 * pow(0.9, -k)) OVER (PARTITION BY user_id ORDER BY k) * pow(0.9, k), 8) + 0.0 AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)")
def loop_scan(spark, sf_dir):
    # Thirds: decayed decimals often end exactly halfway between two roundings.
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") / 3).alias("value"))
    return scan.exponential_scan(rows, "user_id", ["ts", "event_id"], "value", 0.9, "state").select("event_id", _r(F.col("state"), 8).alias("state"))


# -- decompositions and learning ----------------------------------------------------------------------------------------
@query(f"WITH {_E} SELECT round(sum(s), 5) AS total_variance, CAST(64 AS BIGINT) AS axes FROM (SELECT var_pop(v) AS s FROM e GROUP BY i1)")
def pca_variance(spark, sf_dir):
    """The variances along the principal axes add up to those of the features."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    fit = linalg.Whitening.fit(rows, "a")
    return spark.createDataFrame([(float(np.round(fit.variances.sum(), 5)), len(fit.variances))], "total_variance double, axes long")


_PAIR = """m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice / 1000) AS b, var_pop(l_quantity) AS p, var_pop(l_extendedprice / 1000) AS q, covar_pop(l_quantity, l_extendedprice / 1000) AS c FROM lineitem),
    d AS (SELECT *, sqrt(p * q - c * c) AS s, sqrt(p + q + 2 * sqrt(p * q - c * c)) AS t FROM m)"""


@query(f"WITH {_PAIR} SELECT l_orderkey, l_linenumber, round(((q + s) * (l_quantity - a) - c * (l_extendedprice / 1000 - b)) / (s * t), 5) + 0.0 AS x, round(((p + s) * (l_extendedprice / 1000 - b) - c * (l_quantity - a)) / (s * t), 5) + 0.0 AS y FROM lineitem, d")
def zca_whitening(spark, sf_dir):
    """Quantity and price, whitened and rotated back: the inverse square root of a 2 x 2 covariance in closed form."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("a"))
    white = linalg.Whitening.fit(rows, "a", zca=True).transform(rows, "a")
    return white.select("l_orderkey", "l_linenumber", _r(F.col("a")[0], 5).alias("x"), _r(F.col("a")[1], 5).alias("y"))


@query(f"""WITH {_PAIR}, e AS (SELECT *, (p + q) / 2 + sqrt(power((p - q) / 2, 2) + c * c) AS big, (p + q) / 2 - sqrt(power((p - q) / 2, 2) + c * c) AS small FROM d)
    SELECT l_orderkey, l_linenumber, round(abs(c * (l_quantity - a) + (big - p) * (l_extendedprice / 1000 - b)) / sqrt((c * c + power(big - p, 2)) * big), 5) AS first,
           round(abs(c * (l_quantity - a) + (small - p) * (l_extendedprice / 1000 - b)) / sqrt((c * c + power(small - p, 2)) * small), 5) AS second FROM lineitem, e""")
def pca_whitening(spark, sf_dir):
    """Quantity and price along their principal axes; signs aren't unique, so magnitudes."""
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("a"))
    white = linalg.Whitening.fit(rows, "a").transform(rows, "a")
    return white.select("l_orderkey", "l_linenumber", F.round(F.abs(F.col("a")[0]), 5).alias("first"), F.round(F.abs(F.col("a")[1]), 5).alias("second"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS bias, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem")
def linear_regression(spark, sf_dir):
    fit = learn.linear_regression(_table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(fit["bias"], 3), round(fit["l_quantity"], 3))], "bias double, slope double")


@query("""SELECT round(avg(-y * ln(p) - (1 - y) * ln(1 - p)), 6) AS loss, round(avg((p - y) * x), 6) + 0.0 AS g_w, round(avg(p - y), 6) + 0.0 AS g_b
    FROM (SELECT x, y, (tanh((0.3 * x - 0.1) / 2) + 1) / 2 AS p FROM (SELECT l_discount * 10 AS x, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem))""")
def logistic_gradient(spark, sf_dir):
    """Loss of a logistic model and its gradient by reverse-mode derivatives, in one aggregate."""
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    p, y = expr.sigmoid(expr.var("w") * expr.var("x") + expr.var("b")), expr.var("y")
    loss = -(y * expr.unary("log", p)) - (1 - y) * expr.unary("log", 1 - p)
    bind, gradient = {"w": 0.3, "b": -0.1}, loss.gradient(["w", "b"])
    return rows.agg(_r(F.avg(loss.column(bind))).alias("loss"), _r(F.avg(gradient["w"].column(bind))).alias("g_w"), _r(F.avg(gradient["b"].column(bind))).alias("g_b"))


@query(f"WITH {_E}, s AS (SELECT i0, i1, exp(v - max(v) OVER (PARTITION BY i0)) AS x FROM e), t AS (SELECT i0, i1, x / sum(x) OVER (PARTITION BY i0) AS p FROM s) SELECT round(avg(-ln(p)), 6) AS loss, count(*) AS n FROM t JOIN embeddings ON vec_id = i0 AND label = i1")
def softmax_loss(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("a"), "label")
    return rows.agg(_r(learn.softmax_cross_entropy(F.col("a"), F.col("label"))).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(sum(power(l_tax - l_discount, 2)), 4) AS sse, round(avg(power(l_tax - l_discount, 2)), 8) AS mse, round(sqrt(avg(power(l_tax - l_discount, 2))), 6) AS rmse, round(avg(CASE WHEN round_even(l_tax, 0) = l_discount THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem GROUP BY 1")
def model_quality(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_tax", "l_discount")
    out = learn.quality(rows, "l_tax", "l_discount", ["l_returnflag"])
    return out.select("l_returnflag", F.round("sse", 4).alias("sse"), F.round("mse", 8).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("accuracy", 6).alias("accuracy"))


@query("""WITH w AS (SELECT unnest(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word)
    SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM c QUALIFY id <= 100""")
def vocabulary(spark, sf_dir):
    """The 100 most frequent words with ids from 1, ties by word."""
    found = textmodel.Vocabulary.of(_table(spark, sf_dir, "documents"), "text", 100)
    return spark.createDataFrame(list(found.ids.items()), "word string, id long")


@query(f"""WITH {_E}, g AS (SELECT a.i1 AS i, b.i1 AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i0) GROUP BY 1, 2)
    SELECT 'inverse' AS kind, 0.0 AS total, 0.0 AS squares, CAST(1 AS BIGINT) AS n UNION ALL
    SELECT k, round(sum(v) FILTER (i = j), 3), round(sum(v * v), 2), CAST(64 AS BIGINT) FROM g, (VALUES ('eigen'), ('singular')) t(k) GROUP BY k""")
def svd_inverse(spark, sf_dir):
    """Of the Gram matrix of all rows: the largest residual of its inverse, and sums of its eigenvalues and singular values
    and of their squares, which are its trace and the sum of its squared elements."""
    x = _matrix(spark, sf_dir)
    gram = x.transpose().dot(x).copy()
    unit = gram.dot(linalg.invert(gram)) - TensorFrame.identity(spark, WIDTH)
    values, _ = linalg.symmetric_eigen(gram)
    _, s, _ = linalg.svd(gram)
    sums = lambda t, kind: t.df.agg(F.round(F.sum("v"), 3).alias("total"), F.round(F.sum(F.col("v") * F.col("v")), 2).alias("squares"), F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "total", "squares", "n")
    residual = unit.unary("abs").reduce("max").df.select(F.lit("inverse").alias("kind"), F.round("v", 6).alias("total"), F.lit(0.0).alias("squares"), F.lit(1).cast("long").alias("n"))
    return residual.unionByName(sums(values, "eigen")).unionByName(sums(s, "singular"))


@query(f"""WITH {_E}, g AS (SELECT a.i1 AS i, b.i1 AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i0) GROUP BY 1, 2) SELECT i AS i0, CAST(round(sum(v), 4) + 0.0 AS DOUBLE) AS v FROM g GROUP BY i""")
def solve(spark, sf_dir):
    """The row sums of the Gram matrix, back from its eigenvectors and eigenvalues."""
    x = _matrix(spark, sf_dir)
    values, vectors = linalg.symmetric_eigen(x.transpose().dot(x))
    ones = TensorFrame.ones(spark, (WIDTH,))
    return _out(vectors.dot(vectors.transpose().dot(ones) * values), 4)


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS an, 7 + p_partkey % 5 AS ad, 1 - p_partkey % 6 AS bn, 3 + p_partkey % 4 AS bd FROM part),
    s AS (SELECT p_partkey, an * bd + bn * ad AS sn, an * bn AS mn, ad * bd AS d FROM p)
    SELECT p_partkey, sn // gcd(abs(sn), d) AS sum_num, d // gcd(abs(sn), d) AS sum_den, mn // gcd(abs(mn), d) AS mul_num, d // gcd(abs(mn), d) AS mul_den,
           CAST(floor(mn / d) AS BIGINT) AS whole FROM s""")
def rationals(spark, sf_dir):
    """Sums, products and floors of exact fractions."""
    key = F.col("p_partkey")
    a, b = rational.rational(F.col("p_size"), 7 + key % 5), rational.rational(1 - key % 6, 3 + key % 4)
    rows = _table(spark, sf_dir, "part").select(key, rational.add(a, b).alias("s"), rational.multiply(a, b).alias("m"))
    return rows.select(key, F.col("s.num").alias("sum_num"), F.col("s.den").alias("sum_den"), F.col("m.num").alias("mul_num"), F.col("m.den").alias("mul_den"), rational.to_long(rational.floor(F.col("m"))).alias("whole"))


def _window_squares() -> expr.Expr:
    k = elements.total_index("k")
    return elements.total("k", elements.index(1), elements.index(1) + 2, elements.element("x", elements.index(0), k) ** 2)


@query(f"WITH {_E} SELECT i0, i1, round(sum(v * v) OVER (PARTITION BY i0 ORDER BY i1 ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS v FROM e QUALIFY i1 < 62")
def element_sums(spark, sf_dir):
    """An element expression: sums of squares of three neighbouring elements."""
    x = _matrix(spark, sf_dir)
    return _out(elements.elements((x.shape[0], WIDTH - 2), _window_squares(), {"x": x}, spark))


@query(f"WITH {_E} SELECT i0, i1, round(2 * v * (least(i1, 61) - greatest(i1 - 2, 0) + 1), 6) AS v FROM e")
def element_gradient(spark, sf_dir):
    """The derivative of the total of ``element_sums`` by every element it reads."""
    x = _matrix(spark, sf_dir)
    return _out(elements.elements_gradient(_window_squares(), {"x": x}, "x", TensorFrame.ones(spark, (x.shape[0], WIDTH - 2))))


@query("SELECT event_id, round(2 * (1 - power(0.5, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))), 6) AS d_value FROM events")
def loop_gradient(spark, sf_dir):
    """The derivative of the total of all states of a decaying sum by each of its values, by the loop's backward pass."""
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value").withColumn("seed", F.lit(1.0))
    loop = Loop(expr.var("state") * 0.5 + expr.var("value"), "user_id", ["ts", "event_id"], "value")
    return loop.adjoints(rows, "seed").select("event_id", _r(F.col("d_value")).alias("d_value"))


# -- integers ------------------------------------------------------------------------------------------------------------
#: What order keys and part keys are multiplied by.
_BY_ORDER, _BY_PART = 7_000_000_000_000, -90_000_000_000_000


def _times(key: Column, factor: int) -> Column:
    """A key times its factor, wrapped around: from order key 1 317 625 and part key 102 482 on, where the SQL's BIGINT is an error."""
    return scalar.binary("multiply", key, F.lit(factor), "bigint")


def _lines(spark, sf_dir) -> dataset.Dataset:
    columns = ["l_orderkey", "l_linenumber", "l_partkey"]
    return dataset.Dataset.of_samples(_table(spark, sf_dir, "lineitem").select(*columns), columns)


def _line_keys(spark, sf_dir) -> TensorFrame:
    """Multiples of order keys and part keys, and line numbers, of all lines as a matrix of 64-bit integers, large and of both signs."""
    data = _lines(spark, sf_dir)
    keys = data.df.select("sample_id", F.array(*(F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_linenumber"))).alias("a"))
    x = TensorFrame.of_rows(keys, "sample_id", "a", (data.n_samples, 3))
    return x.mapi(lambda i, k, v: F.when(k == 0, _times(v, _BY_ORDER)).when(k == 1, _times(v, _BY_PART)).otherwise(v))


_L = "l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i0, l_orderkey, l_linenumber, l_partkey FROM lineitem), x AS (SELECT i0, CAST(l_orderkey AS BIGINT) * 7000000000000 AS a, -CAST(l_partkey AS BIGINT) * 90000000000000 AS b, CAST(l_linenumber AS BIGINT) AS c FROM l)"
#: SQL of a HUGEINT reduced to 64 bits as integers in two's complement are.
_WRAP = "CAST((({0} % 18446744073709551616) + 27670116110564327424) % 18446744073709551616 - 9223372036854775808 AS BIGINT)"


@query(f"WITH {_L} SELECT i0, {_WRAP.format('(CAST(a AS HUGEINT) * 1000 % 18446744073709551616)')} AS product, {_WRAP.format('(CAST(a AS HUGEINT) + b)')} AS total, b // 7000 AS quotient, b % 7001 AS rest, least(a, b) AS least, a = b AS same FROM x")
def integer_elements(spark, sf_dir):
    """Integers that wrap around, are divided towards zero and are compared exactly."""
    data = _lines(spark, sf_dir)
    pair = F.struct(_times(F.col("l_orderkey"), _BY_ORDER).alias("a"), _times(F.col("l_partkey"), _BY_PART).alias("b"))
    pairs = TensorFrame(data.df.select(F.col("sample_id").alias("i0"), pair.alias("v")), (data.n_samples,))

    def parts(a, b):
        made = {"product": ("multiply", a, F.lit(1000)), "total": ("add", a, b), "quotient": ("divide", b, F.lit(7000)), "rest": ("modulo", b, F.lit(7001)), "least": ("min_elemwise", a, b), "same": ("is_close", a, b)}
        return F.struct(*(scalar.binary(*x, "bigint").alias(n) for n, x in made.items()))

    return pairs.map(lambda v: parts(v["a"], v["b"])).df.select("i0", "v.*")


@query(f"WITH {_L}, y AS (SELECT i0, 0 AS k, a AS v FROM x UNION ALL SELECT i0, 1, b FROM x UNION ALL SELECT i0, 2, c FROM x) SELECT CAST(k AS BIGINT) AS i0, {_WRAP.format('sum(CAST(v AS HUGEINT))')} AS sum, min(v) AS min, max(v) AS max, arg_min(i0, struct_pack(a := v, b := i0)) AS arg_min, arg_min(i0, struct_pack(a := -v, b := i0)) AS arg_max FROM y GROUP BY k")
def integer_reductions(spark, sf_dir):
    """Sums beyond 64 bits, and places of extreme integers that doubles can't tell apart."""
    return _line_keys(spark, sf_dir).summary(["sum", "min", "max", "arg_min", "arg_max"], 0)


@query(f"WITH {_L} SELECT i0, {_WRAP.format('(((CAST(a AS HUGEINT) * b) % 18446744073709551616) * c)')} AS v FROM x")
def integer_product(spark, sf_dir):
    return _line_keys(spark, sf_dir).reduce("product", 1).df


@query(f"WITH {_E}, f AS (SELECT i0 * 64 + i1 AS pos, v FROM e), m AS (SELECT arg_min(pos, struct_pack(a := -v, b := pos)) AS most, arg_min(pos, struct_pack(a := v, b := pos)) AS least FROM f), s AS (SELECT min(pos) AS seen FROM f WHERE floor(v * 4) = 1) SELECT most // 64 AS max0, most % 64 AS max1, least // 64 AS min0, least % 64 AS min1, seen // 64 AS found0, seen % 64 AS found1 FROM m, s")
def search_all(spark, sf_dir):
    """Indices of the greatest and least elements of the whole tensor, and of the first element of a value."""
    x = _matrix(spark, sf_dir)
    row = [*x.arg_all("max"), *x.arg_all("min"), *x.map(lambda v: F.floor(v * 4).cast("double")).find_all(1.0)]
    return spark.createDataFrame([tuple(row)], "max0 long, max1 long, min0 long, min1 long, found0 long, found1 long")


# -- tensor expressions, layers, loops of several channels -----------------------------------------------------------------
@query(f"""WITH {_E}, w AS (SELECT i, (i % 5 - 2) / 10.0 AS w FROM range(64) t(i)), z AS (SELECT i0, tanh(sum(v * w)) AS z FROM e JOIN w ON i = i1 GROUP BY i0)
    SELECT i1 AS i0, round(sum(2 * z * (1 - z * z) * v), 4) + 0.0 AS v FROM e JOIN z USING (i0) GROUP BY i1""")
def expression_gradient(spark, sf_dir):
    """The gradient of the sum of squares of tanh(X w) by w: an expression of tensors, differentiated, as one plan."""
    x = _matrix(spark, sf_dir)
    loss = T.total(T.unary("tanh", T.var("x", x.shape) @ T.var("w", (WIDTH,))) ** 2.0)
    w = TensorFrame.init(spark, (WIDTH,), lambda i: (i % 5 - 2) / 10.0)
    return _out(loss.gradient(["w"])["w"].frame(spark, {"x": x, "w": w}), 4)


@query(f"""WITH {_E}, k AS (SELECT unnest(range(2)) AS k), h AS (SELECT i0, k, tanh(sum(v * ((i1 + k) % 7 - 3) / 20.0) + 0.1 * k) AS h FROM e, k GROUP BY i0, k),
    o AS (SELECT i0, h.k AS k, h, (sum(h * (CASE WHEN h.k = 0 THEN 0.5 ELSE -0.25 END)) OVER (PARTITION BY i0)) - 0.2 AS p FROM h), y AS (SELECT vec_id AS i0, CAST(label AS DOUBLE) AS y FROM embeddings)
    SELECT round(avg(power(p - y, 2)) FILTER (k = 0), 6) AS loss, round(avg(2 * (p - y)) FILTER (k = 0), 6) + 0.0 AS g_bias, round(avg(2 * (p - y) * h) FILTER (k = 0), 6) + 0.0 AS g_out0, round(avg(2 * (p - y) * h) FILTER (k = 1), 6) + 0.0 AS g_out1,
           round(avg(2 * (p - y) * 0.5 * (1 - h * h)) FILTER (k = 0), 6) + 0.0 AS g_hidden0, round(avg(2 * (p - y) * -0.25 * (1 - h * h)) FILTER (k = 1), 6) + 0.0 AS g_hidden1 FROM o JOIN y USING (i0)""")
def perceptron_gradient(spark, sf_dir):
    """Loss of a perceptron with a hidden layer over all embeddings, and its gradient by biases and the last layer's weights."""
    net = model.Perceptron(WIDTH, (2, 1), ("tanh", "identity"), "mse")
    i, k = np.arange(WIDTH), np.arange(2)[:, None]
    flat = net.parameters.pack({"layer0.weights": ((i + k) % 7 - 3) / 20.0, "layer0.bias": np.array([0.0, 0.1]), "layer1.weights": np.array([[0.5, -0.25]]), "layer1.bias": np.array([-0.2])})
    rows = _table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("input"), F.array(F.col("label").cast("double")).alias("target"))
    loss, slopes = model.loss_and_gradient(net, rows, flat)
    g = net.parameters.unpack(slopes)
    row = [loss, g["layer1.bias"][0], *g["layer1.weights"][0], *g["layer0.bias"]]
    return spark.createDataFrame([tuple(round(float(x), 6) + 0.0 for x in row)], "loss double, g_bias double, g_out0 double, g_out1 double, g_hidden0 double, g_hidden1 double")


@query("""WITH RECURSIVE k AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
    s(user_id, event_id, k, level, trend, before) AS (
        SELECT user_id, event_id, k, CAST(value * 0.4 + 0.3 AS DOUBLE), CAST(0.35 AS DOUBLE), CAST(0.0 AS DOUBLE) FROM k WHERE k = 0
        UNION ALL SELECT k.user_id, k.event_id, k.k, k.value * 0.4 + 0.6 * (s.level + s.trend), 0.3 * (s.level - s.before) + 0.7 * s.trend, s.level FROM s JOIN k ON k.user_id = s.user_id AND k.k = s.k + 1)
    SELECT event_id, round(level, 5) + 0.0 AS level, round(trend, 5) + 0.0 AS trend, CAST(k AS DOUBLE) AS at FROM s""")
def loop_channels(spark, sf_dir):
    """Level and trend along each user's events: two channels, one of which is read two iterations back, and the iteration."""
    steps = {"level": expr.var("value") * 0.4 + 0.6 * (previous("level") + previous("trend")), "trend": 0.3 * (previous("level") - previous("level", 2)) + 0.7 * previous("trend"), "at": expr.var(ITERATION) + 0.0}
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = Channels(steps, "user_id", ["ts", "event_id"], {"level": [0.0, 0.0], "trend": [0.5]}).states(rows)
    return out.select("event_id", _r(F.col("level"), 5).alias("level"), _r(F.col("trend"), 5).alias("trend"), "at")
