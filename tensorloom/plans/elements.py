"""Tensors given by an expression for one element, with derivatives by the tensors they read.

``element("x", index(0), total_index("k"))`` is an element of an argument at index expressions; ``total("k", 0, 4, e)``
sums over an inclusive range.  Reading an argument is an equi-join on the index values, a sum is a generated range and a
group by the outer indices, and a derivative sends the slopes back along the same joins: rows of (index values, slope)
are summed per element, so no derivative needs more rows than the values did.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.frame import TensorFrame
from tensorloom.plans.expr import Expr, var, where_greater, wrap

SUM, ELEMENT = "element_sum", "element_of"


def index(axis: int) -> Expr:
    """The result's index along an axis."""
    return var(f"i{axis}")


def total_index(name: str) -> Expr:
    """The index of a sum."""
    return var(f"s_{name}")


def element(argument: str, *at) -> Expr:
    return Expr(ELEMENT, (argument, *map(wrap, at)))


def total(name: str, first, last, body) -> Expr:
    """Sum of ``body`` for the index from first to last, both included; an empty range gives 0."""
    return Expr(SUM, (f"s_{name}", wrap(first), wrap(last), wrap(body)))


def where_equal(a, b, yes, no) -> Expr:
    return where_greater(a, b, no, where_greater(b, a, no, yes))


def within(at, first, last, body) -> Expr:
    """``body`` where first <= at <= last, else 0."""
    return where_greater(first, at, 0, where_greater(at, last, 0, body))


def _outermost(e: Expr) -> Iterator[Expr]:
    """The sums and elements that stand in no other sum."""
    if e.op in (SUM, ELEMENT):
        yield e
    else:
        for a in e.args:
            if isinstance(a, Expr):
                yield from _outermost(a)


def _whole(e: Expr) -> Column:
    return e.column().cast("long")


class _Domain:
    """Rows that are told apart by index columns, and the arguments that can be read there."""

    def __init__(self, rows: DataFrame, keys: list[str], arguments: Mapping[str, TensorFrame]):
        self.rows, self.keys, self.arguments = rows, keys, arguments

    def widened(self, e: Expr) -> _Domain:
        """The domain of a sum's body."""
        name, first, last, _ = e.args
        lo, hi = _whole(first), _whole(last)
        span = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        return _Domain(self.rows.withColumn(name, F.explode(span)), [*self.keys, name], self.arguments)

    def attach(self, e: Expr) -> tuple[_Domain, Expr, dict[str, Expr]]:
        """This domain with a column for each outermost part, ``e`` over those columns, and the parts by column."""
        rows, parts = self.rows, {}
        for k, part in enumerate(dict.fromkeys(_outermost(e))):
            name = f"p{len(self.keys)}_{k}"
            parts[name] = part
            e = e.subst(part, var(name))
            if part.op == SUM:
                inner = self.only_keys().widened(part)
                sums = inner.values(part.args[3]).groupBy(*self.keys).agg(F.sum("v").alias(name))
                rows = (rows.join(sums, self.keys, "left") if self.keys else rows.crossJoin(sums)).withColumn(name, F.coalesce(name, F.lit(0.0)))
                continue
            read = self.arguments[part.args[0]]
            at = [f"{name}_{d}" for d in range(read.n_dims)]
            if len(part.args) - 1 != len(at):
                raise ValueError(f"{part.args[0]} has {len(at)} axes")
            own = read.df.select(*(F.col(f"i{d}").alias(c) for d, c in enumerate(at)), F.col("v").cast("double").alias(name))
            rows = rows.withColumns({c: _whole(x) for c, x in zip(at, part.args[1:], strict=True)})
            rows = rows.join(own, at, "left") if at else rows.crossJoin(own)
        return _Domain(rows, self.keys, self.arguments), e, parts

    def only_keys(self) -> _Domain:
        return _Domain(self.rows.select(*self.keys), self.keys, self.arguments)

    def values(self, e: Expr) -> DataFrame:
        """The keys and ``v``; reading outside an argument is an error unless a condition leaves it out."""
        full, plain, _ = self.attach(e)
        v = plain.column()
        return full.rows.select(*self.keys, F.coalesce(v, F.raise_error(F.lit("an index is outside its argument")).cast("double")).alias("v"))

    def slopes(self, e: Expr, seed: str, wanted: str) -> Iterator[DataFrame]:
        """Rows of index values and slopes for every reading of ``wanted`` in ``e``; ``seed`` is the slope by ``e``."""
        full, plain, parts = self.attach(e)
        gradient = plain.gradient(list(parts))
        for name, part in parts.items():
            slope = F.col(seed) * gradient[name].column()
            if part.op == SUM:
                below = full.rows.select(*self.keys, slope.alias(f"{seed}_"))
                yield from _Domain(below, self.keys, self.arguments).widened(part).slopes(part.args[3], f"{seed}_", wanted)
            elif part.args[0] == wanted:
                columns = [F.col(f"{name}_{d}").alias(f"i{d}") for d in range(len(part.args) - 1)]
                # null: a reading outside the argument, which a condition left out
                yield full.rows.select(*columns, slope.alias("v")).where("v IS NOT NULL AND v <> 0")


def elements(shape, e, arguments: Mapping[str, TensorFrame], spark) -> TensorFrame:
    """The tensor of a shape whose elements are ``e``."""
    base = TensorFrame.zeros(spark, shape)
    keys = [f"i{d}" for d in range(len(shape))]
    return TensorFrame(_Domain(base.df.select(*keys), keys, arguments).values(wrap(e)), shape)


def elements_gradient(e, arguments: Mapping[str, TensorFrame], wanted: str, seed: TensorFrame) -> TensorFrame:
    """Derivative by the argument ``wanted`` of the sum over all elements of seed * e; ``seed`` has the result's shape."""
    keys = [f"i{d}" for d in range(seed.n_dims)]
    rows = seed.df.select(*keys, F.col("v").cast("double").alias("seed"))
    found = list(_Domain(rows, keys, arguments).slopes(wrap(e), "seed", wanted))
    target = arguments[wanted]
    own = [f"i{d}" for d in range(target.n_dims)]
    if not found:
        return target.map(lambda v: F.lit(0.0))
    sums = reduce(DataFrame.unionByName, found).groupBy(*own).agg(F.sum("v").alias("_sum"))
    every = target.df.select(*own)
    joined = every.join(sums, own, "left") if own else every.crossJoin(sums)
    return TensorFrame(joined.select(*own, F.coalesce("_sum", F.lit(0.0)).alias("v")), target.shape)
