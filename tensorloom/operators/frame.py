"""TensorFrame: an n-d array as a DataFrame of index columns i0, i1, ... and a value column v, with a known shape.

Every index of the shape is present (dense).  Elementwise operations join on the index columns of axes that both sides
have; an axis of size 1 is left out of the join, which is how it is broadcast.  Reductions group by the other axes.
Nothing is computed before an action, and nothing passes through the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce as fold

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import scalar
from tensorloom.functions.scalar import BITS, NOT_FOUND, divide

#: Slice items.
ALL, NEW_AXIS = slice(None), None
REMAINDER = -1
#: Axes that are certainly small enough for a broadcast: elements of a known shape, not a guess.
BROADCAST_ELEMENTS = 100_000
#: Elements of an axis that one window of ``diff_axis`` covers.
DIFF_BLOCK = 4096
#: Single products from which matrices are multiplied in tiles, and the rows and columns of a tile.
TILED_PRODUCTS, TILE = 50_000_000, 512
#: Elements of an axis that one task multiplies at a time where a product of integers must wrap around.
PRODUCT_BLOCK = 1024
#: Elements of an axis up to which such a product is made of one aggregate for each of them, which needs no lists.
PRODUCT_SHORT = 16
#: Groups up to which places of extreme elements are found without grouping, as Spark sorts all rows by group for them.
FEW_GROUPS = 16


def _i(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


class TensorFrame:
    def __init__(self, df: DataFrame, shape: Sequence[int]):
        self.shape = tuple(int(n) for n in shape)
        self.df = df.select(*_i(len(self.shape)), "v")

    # -- making ----------------------------------------------------------------------------------------------------
    @classmethod
    def init(cls, spark: SparkSession, shape: Sequence[int], value: Callable[..., Column]) -> TensorFrame:
        """Each element from its index columns."""
        shape = tuple(shape)
        base, left, index = spark.range(math.prod(shape)), F.col("id"), []
        for n in reversed(shape):
            index.insert(0, left % F.lit(max(n, 1)))
            left = _div(left, max(n, 1))
        named = base.select(*(c.cast("long").alias(f"i{k}") for k, c in enumerate(index)))
        return cls(named.withColumn("v", value(*map(F.col, _i(len(shape))))), shape)

    @classmethod
    def filled(cls, spark, shape, value) -> TensorFrame:
        return cls.init(spark, shape, lambda *i: F.lit(value))

    @classmethod
    def zeros(cls, spark, shape) -> TensorFrame:
        return cls.filled(spark, shape, 0.0)

    @classmethod
    def ones(cls, spark, shape) -> TensorFrame:
        return cls.filled(spark, shape, 1.0)

    @classmethod
    def falses(cls, spark, shape) -> TensorFrame:
        return cls.filled(spark, shape, False)

    @classmethod
    def trues(cls, spark, shape) -> TensorFrame:
        return cls.filled(spark, shape, True)

    @classmethod
    def empty(cls, spark, n_dims: int) -> TensorFrame:
        return cls.zeros(spark, (0,) * n_dims)

    @classmethod
    def scalar(cls, spark, value) -> TensorFrame:
        return cls.filled(spark, (), value)

    @classmethod
    def identity(cls, spark, n: int) -> TensorFrame:
        return cls.init(spark, (n, n), lambda a, b: F.when(a == b, 1.0).otherwise(0.0))

    @classmethod
    def counting(cls, spark, n: int) -> TensorFrame:
        return cls.init(spark, (n,), lambda i: i)

    @classmethod
    def arange(cls, spark, start, incr, stop) -> TensorFrame:
        """Truncating count: (0, 3, 10) gives 0, 3, 6."""
        return cls.init(spark, (max(0, math.trunc((stop - start) / incr)),), lambda i: F.lit(start) + i * F.lit(incr))

    @classmethod
    def linspace(cls, spark, start: float, stop: float, n: int) -> TensorFrame:
        if n < 2:
            raise ValueError("linspace needs two elements at least")
        return cls.init(spark, (n,), lambda i: F.lit(float(start)) + i * F.lit((stop - start) / (n - 1)))

    @classmethod
    def random_uniform(cls, spark, shape, low=0.0, high=1.0, seed: int = 0) -> TensorFrame:
        return cls.init(spark, shape, lambda *i: F.rand(seed) * (high - low) + low)

    @classmethod
    def random_int(cls, spark, shape, low: int, high: int, seed: int = 0) -> TensorFrame:
        return cls.init(spark, shape, lambda *i: F.floor(F.rand(seed) * (high - low)) + low)

    @classmethod
    def random_normal(cls, spark, shape, mean=0.0, variance=1.0, seed: int = 0) -> TensorFrame:
        return cls.init(spark, shape, lambda *i: F.randn(seed) * math.sqrt(variance) + mean)

    @classmethod
    def of_numpy(cls, spark, array: np.ndarray) -> TensorFrame:
        import pandas as pd

        array = np.asarray(array)
        index = np.indices(array.shape).reshape(array.ndim, array.size)
        table = pd.DataFrame({f"i{k}": index[k].astype(np.int64) for k in range(array.ndim)} | {"v": array.reshape(-1)})
        if not len(table):
            kind = {"b": "boolean", "i": "long", "u": "long", "f": "double"}[array.dtype.kind]
            return cls(spark.createDataFrame([], ", ".join([*(f"i{k} long" for k in range(array.ndim)), f"v {kind}"])), array.shape)
        return cls(spark.createDataFrame(table), array.shape)

    @classmethod
    def of_rows(cls, df: DataFrame, row: str, array: str, shape: tuple[int, int]) -> TensorFrame:
        """A matrix from one array column per row."""
        return cls(df.select(F.col(row).cast("long").alias("i0"), F.posexplode(array).alias("i1", "v")).withColumn("i1", F.col("i1").cast("long")), shape)

    @classmethod
    def of_seq(cls, spark: SparkSession, values, shape: Sequence[int]) -> TensorFrame:
        """The first elements of an iterable in row-major order; ValueError if there are too few."""
        shape = tuple(shape)
        found = list(itertools.islice(values, math.prod(shape)))
        if len(found) < math.prod(shape):
            raise ValueError(f"{len(found)} values for {shape}")
        return cls.of_numpy(spark, np.array(found).reshape(shape))

    # -- reading ---------------------------------------------------------------------------------------------------
    @property
    def n_dims(self) -> int:
        return len(self.shape)

    @property
    def n_elems(self) -> int:
        return math.prod(self.shape)

    @property
    def dtype(self) -> str:
        return self.df.schema["v"].dataType.simpleString()

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def numpy(self) -> np.ndarray:
        """All elements on the driver; for small tensors."""
        table = self.df.toPandas()
        kind = {"boolean": bool, "bigint": np.int64, "int": np.int32, "double": float, "float": np.float32}.get(self.dtype, object)
        out = np.zeros(self.shape, kind)
        if len(table):
            out[tuple(table[f"i{k}"].to_numpy() for k in range(self.n_dims))] = table["v"].to_numpy() if self.n_dims else table["v"].iloc[0]
        return out

    def to_list(self) -> list:
        """Nested lists; for small tensors."""
        return self.numpy().tolist()

    def elements(self) -> Iterator[tuple[tuple[int, ...], object]]:
        """(indices, value) in row-major order, one partition at a time."""
        for r in self.df.orderBy(*_i(self.n_dims)).toLocalIterator():
            yield tuple(r[: self.n_dims]), r["v"]

    def pretty(self, most: int = 10) -> str:
        """The first elements of every axis as text."""
        shown = self.slice(*((0, min(n, most) - 1) for n in self.shape)).numpy() if self.n_elems else np.zeros(self.shape)
        more = any(n > most for n in self.shape)
        return f"{self.dtype}{list(self.shape)}{' (beginning)' if more else ''}\n{shown}"

    def copy(self) -> TensorFrame:
        """This tensor computed once and kept by the executors."""
        return TensorFrame(self.df.persist(), self.shape)

    @property
    def is_broadcasted(self) -> bool:
        """Elements are rows of their own here, so no axis repeats one without holding it."""
        return False

    def element(self, *index: int):
        for n, i in zip(self.shape, index, strict=True):
            if not 0 <= i < n:
                raise IndexError(index)
        return self.df.where(fold(lambda a, b: a & b, (F.col(f"i{k}") == i for k, i in enumerate(index)), F.lit(True))).first()["v"]

    # -- shape -----------------------------------------------------------------------------------------------------
    def _axes(self, columns: Sequence[Column], shape: Sequence[int], where: Column | None = None) -> TensorFrame:
        df = self.df if where is None else self.df.where(where)
        return TensorFrame(df.select(*(c.cast("long").alias(f"i{k}") for k, c in enumerate(columns)), "v"), shape)

    def _index(self) -> list[Column]:
        return [F.col(c) for c in _i(self.n_dims)]

    def slice(self, *items) -> TensorFrame:
        """Inclusive ranges (first, last), single indices, ``ALL``, ``NEW_AXIS`` and one ``...``."""
        items = list(items)
        used = sum(x is not None and x is not Ellipsis for x in items)
        if Ellipsis in items:
            at = items.index(Ellipsis)
            items[at : at + 1] = [ALL] * (self.n_dims - used)
        else:
            items += [ALL] * (self.n_dims - used)
        columns, shape, where, k = [], [], F.lit(True), 0
        for x in items:
            if x is None:
                columns.append(F.lit(0)), shape.append(1)
                continue
            c, n = F.col(f"i{k}"), self.shape[k]
            k += 1
            if isinstance(x, int):
                if not 0 <= x < n:
                    raise IndexError(x)
                where &= c == x
            elif x == ALL:
                columns.append(c), shape.append(n)
            else:
                first, last = (0 if x[0] is None else x[0]), (n - 1 if x[1] is None else x[1])
                if first < 0 or last >= n or first > n:
                    raise IndexError(x)
                where &= c.between(first, last)
                columns.append(c - first), shape.append(max(0, last - first + 1))
        return self._axes(columns, shape, where)

    def set_slice(self, ranges: Sequence, value) -> TensorFrame:
        """Elements within inclusive ranges replaced by a number or a tensor that broadcasts to them."""
        bounds = [(r, r) if isinstance(r, int) else (0, n - 1) if r == ALL else r for r, n in zip(ranges, self.shape, strict=True)]
        hit = fold(lambda a, b: a & b, (F.col(f"i{k}").between(a, b) for k, (a, b) in enumerate(bounds)), F.lit(True))
        if not isinstance(value, TensorFrame):
            return TensorFrame(self.df.withColumn("v", F.when(hit, F.lit(value)).otherwise(F.col("v"))), self.shape)
        part = value.broadcast_to([b - a + 1 for a, b in bounds])
        moved = part.df.select(*((F.col(f"i{k}") + a).alias(f"i{k}") for k, (a, _) in enumerate(bounds)), F.col("v").alias("w"), F.lit(True).alias("hit"))
        return TensorFrame(self.df.join(moved, _i(self.n_dims), "left").withColumn("v", F.when(F.col("hit"), F.col("w")).otherwise(F.col("v"))), self.shape)

    def insert_axis(self, at: int) -> TensorFrame:
        c, s = self._index(), list(self.shape)
        return self._axes([*c[:at], F.lit(0), *c[at:]], [*s[:at], 1, *s[at:]])

    def pad_left(self) -> TensorFrame:
        return self.insert_axis(0)

    def pad_right(self) -> TensorFrame:
        return self.insert_axis(self.n_dims)

    def cut_left(self) -> TensorFrame:
        return self.slice(0)

    def cut_right(self) -> TensorFrame:
        return self.slice(..., 0)

    def at_least_nd(self, n: int) -> TensorFrame:
        return self if self.n_dims >= n else self.pad_left().at_least_nd(n)

    def broadcast_to(self, shape: Sequence[int]) -> TensorFrame:
        """Axes of size 1 repeated; missing axes are added on the left."""
        out = self.at_least_nd(len(shape))
        for k, (have, want) in enumerate(zip(out.shape, shape, strict=True)):
            if have == want:
                continue
            if have != 1:
                raise ValueError(f"cannot broadcast {self.shape} to {tuple(shape)}")
            c, s = out._index(), list(out.shape)
            spread = out.df.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(want - 1).cast("long")) if want else F.array().cast("array<bigint>")))
            s[k] = want
            out = TensorFrame(spread, s)
        return out

    def reshape(self, shape: Sequence[int]) -> TensorFrame:
        """Row-major; one axis may be ``REMAINDER``."""
        shape = list(shape)
        if REMAINDER in shape:
            known = -math.prod(shape)
            shape[shape.index(REMAINDER)] = self.n_elems // max(known, 1)
        if math.prod(shape) != self.n_elems:
            raise ValueError(f"cannot reshape {self.shape} to {shape}")
        line = self.linear_index()
        columns = []
        for n in reversed(shape):
            columns.insert(0, line % max(n, 1))
            line = _div(line, max(n, 1))
        return self._axes(columns, shape)

    def try_reshape(self, shape: Sequence[int]) -> TensorFrame | None:
        """As ``reshape``; None where the sizes don't fit."""
        try:
            return self.reshape(shape)
        except ValueError:
            return None

    def flatten(self) -> TensorFrame:
        return self.reshape([REMAINDER]) if self.n_elems else self.reshape([0])

    def linear_index(self) -> Column:
        out = F.lit(0).cast("long")
        for c, n in zip(self._index(), self.shape, strict=True):
            out = out * n + c
        return out

    def permute_axes(self, to: Sequence[int]) -> TensorFrame:
        """Axis k moves to position ``to[k]``."""
        back = [list(to).index(k) for k in range(self.n_dims)]
        c = self._index()
        return self._axes([c[k] for k in back], [self.shape[k] for k in back])

    def swap_dim(self, a: int, b: int) -> TensorFrame:
        to = list(range(self.n_dims))
        to[a], to[b] = b, a
        return self.permute_axes(to)

    def transpose(self) -> TensorFrame:
        return self.swap_dim(self.n_dims - 2, self.n_dims - 1)

    def reverse_axis(self, axis: int) -> TensorFrame:
        c = self._index()
        c[axis] = self.shape[axis] - 1 - c[axis]
        return self._axes(c, self.shape)

    def diag_axis(self, a: int, b: int) -> TensorFrame:
        if self.shape[a] != self.shape[b]:
            raise ValueError("a diagonal needs axes of one size")
        a, b = sorted((a, b))
        c, s = self._index(), list(self.shape)
        return self._axes([*c[:b], *c[b + 1 :]], [*s[:b], *s[b + 1 :]], c[a] == c[b])

    def diag(self) -> TensorFrame:
        return self.diag_axis(self.n_dims - 2, self.n_dims - 1)

    def diag_mat(self) -> TensorFrame:
        """The last axis on the diagonal of the last two, zeros elsewhere."""
        return self.diag_mat_axis(self.n_dims - 1, self.n_dims)

    def diag_mat_axis(self, a: int, b: int) -> TensorFrame:
        """Axis min(a, b) on the diagonal of axes a and b of the result, zeros elsewhere."""
        a, b = sorted((a, b))
        if a == b or not 0 <= a < self.n_dims or b > self.n_dims:
            raise ValueError(f"no diagonal of axes {a} and {b}")
        wide = self.insert_axis(b)
        shape = list(wide.shape)
        shape[b] = self.shape[a]
        wide = wide.broadcast_to(shape)
        return TensorFrame(wide.df.withColumn("v", F.when(F.col(f"i{a}") == F.col(f"i{b}"), F.col("v")).otherwise(F.lit(0).cast(self.dtype))), wide.shape)

    def convert(self, kind: str) -> TensorFrame:
        """Elements as another type; see ``scalar.convert``."""
        return self.map(lambda v: scalar.convert(v, self.dtype, kind))

    # -- elementwise -----------------------------------------------------------------------------------------------
    def map(self, fn: Callable[[Column], Column]) -> TensorFrame:
        return TensorFrame(self.df.withColumn("v", fn(F.col("v"))), self.shape)

    def mapi(self, fn: Callable[..., Column]) -> TensorFrame:
        return TensorFrame(self.df.withColumn("v", fn(*self._index(), F.col("v"))), self.shape)

    def mapi2(self, other, fn: Callable[..., Column]) -> TensorFrame:
        """``fn`` of the indices and both elements, for tensors that broadcast to each other."""
        pair = self.map2(other, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return pair.mapi(lambda *x: fn(*x[:-1], x[-1]["a"], x[-1]["b"]))

    def all_finite(self) -> bool:
        return self.unary("is_finite").reduce("all").element()

    def unary(self, name: str) -> TensorFrame:
        return self.map(lambda v: scalar.unary(name, v, self.dtype))

    def map2(self, other, fn: Callable[[Column, Column], Column]) -> TensorFrame:
        if not isinstance(other, TensorFrame):
            return self.map(lambda v: fn(v, F.lit(other)))
        n = max(self.n_dims, other.n_dims)
        a, b = self.at_least_nd(n), other.at_least_nd(n)
        for x, y in zip(a.shape, b.shape, strict=True):
            if x != y and 1 not in (x, y):
                raise ValueError(f"shapes {self.shape} and {other.shape} do not match")
        shape = [y if x == 1 else x for x, y in zip(a.shape, b.shape, strict=True)]
        if any(x != s for x, s in zip(a.shape, shape, strict=True)) and any(y != s for y, s in zip(b.shape, shape, strict=True)):
            a = a.broadcast_to(shape)  # each side lacks an axis: repeat one
        keys = [f"i{k}" for k in range(n) if a.shape[k] == b.shape[k]]
        right = b.df.select(*(F.col(f"i{k}").alias(f"j{k}") for k in range(n)), F.col("v").alias("w"))
        if min(a.n_elems, b.n_elems) <= BROADCAST_ELEMENTS and b.n_elems <= a.n_elems:
            right = F.broadcast(right)
        on = fold(lambda p, q: p & q, (F.col(k) == F.col("j" + k[1:]) for k in keys), F.lit(True))
        both = a.df.join(right, on)
        index = [F.col(f"i{k}") if a.shape[k] == shape[k] else F.col(f"j{k}") for k in range(n)]
        return TensorFrame(both.select(*(c.alias(f"i{k}") for k, c in enumerate(index)), fn(F.col("v"), F.col("w")).alias("v")), shape)

    def binary(self, name: str, other) -> TensorFrame:
        kind = self.dtype
        if isinstance(other, TensorFrame):
            if other.dtype != kind and not (kind in BITS and other.dtype in BITS):
                kind = "double"
            elif kind in BITS:
                kind = max(kind, other.dtype, key=BITS.get)
        elif kind in BITS and isinstance(other, float):
            kind = "double"
        return self.map2(other, lambda a, b: scalar.binary(name, a, b, kind))

    def __add__(self, other):
        return self.binary("add", other)

    def __sub__(self, other):
        return self.binary("subtract", other)

    def __mul__(self, other):
        return self.binary("multiply", other)

    def __truediv__(self, other):
        return self.binary("divide", other)

    def __mod__(self, other):
        return self.binary("modulo", other)

    def __pow__(self, other):
        return self.binary("power", other)

    def __neg__(self):
        return self.unary("negate")

    def if_then_else(self, yes: TensorFrame, no: TensorFrame) -> TensorFrame:
        pair = yes.map2(no, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return self.map2(pair, lambda c, p: F.when(c, p["a"]).otherwise(p["b"]))

    def is_close(self, other, **tolerance) -> TensorFrame:
        if self.dtype in BITS or self.dtype == "boolean":
            return self.map2(other, lambda a, b: a == b)
        return self.map2(other, lambda a, b: scalar.is_close(a, b, **tolerance))

    def almost_equal(self, other: TensorFrame, **tolerance) -> bool:
        return self.shape == other.shape and self.is_close(other, **tolerance).reduce("all").element()

    def check_finite(self) -> TensorFrame:
        return self.map(lambda v: F.when(scalar.unary("is_finite", v, self.dtype), v).otherwise(F.raise_error(F.lit("a value that is not finite"))))

    # -- reductions ------------------------------------------------------------------------------------------------
    def reduce(self, name: str, axis: int | None = None, keep: bool = False, **options) -> TensorFrame:
        """sum product min max all any count_true mean var std norm over an axis (None: over all), with the identity for empty axes.

        Sums and products of integers wrap around and are exact otherwise.
        """
        if axis is None:
            return self.flatten().reduce(name, 0, **options)
        n = self.shape[axis]
        if name == "product" and self.dtype in BITS and n > PRODUCT_BLOCK:
            # Blocks of a bounded size first.
            at = F.col(f"i{axis}")
            blocks = self.df.groupBy(*[f"i{k}" for k in range(self.n_dims) if k != axis], _div(at, PRODUCT_BLOCK).alias(f"i{axis}")).agg(_aggregate(name, F.col("v"), self.dtype, n, options)[0].alias("v"))
            shape = list(self.shape)
            shape[axis] = -(-n // PRODUCT_BLOCK)
            return TensorFrame(blocks, shape).reduce(name, axis, keep)
        others = [f"i{k}" for k in range(self.n_dims) if k != axis]
        shape = [s for k, s in enumerate(self.shape) if k != axis]
        value, kind = _aggregate(name, F.col("v"), self.dtype, n, options)
        if name == "product" and kind in BITS and 0 < n <= PRODUCT_SHORT:
            df = self.df.groupBy(*others).agg(*(F.coalesce(F.max(F.when(F.col(f"i{axis}") == k, F.col("v"))), F.lit(1).cast(kind)).alias(f"_{k}") for k in range(n)))
            df = df.withColumn("v", F.col("_0"))
            for k in range(1, n):
                df = df.withColumn("v", scalar.binary("multiply", F.col("v"), F.col(f"_{k}"), kind))
        else:
            df = self.df.groupBy(*others).agg(value.alias("v"))
        if n == 0:
            df = TensorFrame.init(self.spark, shape, lambda *i: F.lit(0)).df.crossJoin(self.df.agg(value.alias("w"))).withColumn("v", F.col("w")) if shape else self.df.agg(value.alias("v"))
            others = _i(len(shape))
        out = TensorFrame(df.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(others)), F.col("v").cast(kind).alias("v")), shape)
        return out.insert_axis(axis) if keep else out

    def summary(self, names: Sequence[str], axis: int | None = None, **options) -> DataFrame:
        """Several reductions by one aggregation: the other axes' indices and a column for each name.

        Besides the names of ``reduce``: ``arg_min`` and ``arg_max`` (along an axis)."""
        if axis is None:
            return self.flatten().summary(names, 0, **options)
        others = [f"i{k}" for k in range(self.n_dims) if k != axis]
        shape = [s for k, s in enumerate(self.shape) if k != axis]

        def made(hit: Column) -> list[Column]:
            out = []
            for name in names:
                if name.startswith("arg_"):
                    usable, order = self._first(name[4:])
                    first = F.min(F.when(hit & usable, F.struct(F.when(usable, order).alias("v"), F.col(f"i{axis}").alias("at"))))["at"]
                    out.append(F.coalesce(first, F.lit(NOT_FOUND)).alias(name))
                else:
                    value, kind = _aggregate(name, F.when(hit, F.col("v")), self.dtype, self.shape[axis], options)
                    out.append(value.cast(kind).alias(name))
            return out

        if not any(name.startswith("arg_") for name in names) or not others or not 0 < math.prod(shape) <= FEW_GROUPS:
            found = self.df.groupBy(*others).agg(*made(F.lit(True)))
            return found.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(others)), *names)
        rows = []
        for at in itertools.product(*map(range, shape)):
            hit = fold(lambda a, b: a & b, (F.col(c) == i for c, i in zip(others, at, strict=True)))
            index = (F.lit(i).cast("long").alias(f"i{k}") for k, i in enumerate(at))
            rows.append(F.when(F.count_if(hit) > 0, F.struct(*index, *made(hit))))
        return self.df.agg(F.array_compact(F.array(*rows)).alias("_rows")).select(F.inline("_rows"))

    def sum(self, axis=None):
        return self.reduce("sum", axis)

    def mean(self, axis=None):
        return self.reduce("mean", axis)

    def _first(self, name: str) -> tuple[Column, Column]:
        """Which elements may win, and what makes the least of them win; NaN and the type's limit itself never win."""
        v, (low, high) = F.col("v"), scalar.limits(self.dtype)
        usable = v < F.lit(high) if name == "min" else v > F.lit(low)
        return (usable if self.dtype in BITS else usable & ~F.isnan(v)), (v if name == "min" else -v)

    def arg(self, name: str, axis: int) -> TensorFrame:
        """Index of the first least ("min") or greatest ("max") element along an axis; NaN never wins."""
        df = self.summary([f"arg_{name}"], axis).withColumnRenamed(f"arg_{name}", "v")
        return TensorFrame(df, [s for k, s in enumerate(self.shape) if k != axis])

    def arg_all(self, name: str) -> list[int]:
        """Indices of the first least or greatest element of the whole tensor; ValueError where there is none."""
        usable, order = self._first(name)
        row = self.df.agg(F.min(F.when(usable, F.struct(F.when(usable, order).alias("v"), self.linear_index().alias("at"))))["at"].alias("at")).first()
        if row["at"] is None:
            raise ValueError(f"no element that could be the {name}")
        return self.linear_to_idx(row["at"])

    def _equal(self, value) -> Column:
        same = F.col("v") == F.lit(value)
        return same if self.dtype in BITS or self.dtype == "boolean" else same & ~F.isnan(F.col("v"))

    def find(self, value, axis: int) -> TensorFrame:
        """First index along an axis whose element equals a value; NaN equals nothing."""
        return self._by_axis(axis, F.coalesce(F.min(F.when(self._equal(value), F.col(f"i{axis}"))), F.lit(NOT_FOUND)))

    def try_find(self, value) -> list[int] | None:
        """Indices of the first element, in row-major order, that equals a value."""
        at = self.df.where(self._equal(value)).agg(F.min(self.linear_index()).alias("at")).first()["at"]
        return None if at is None else self.linear_to_idx(at)

    def find_all(self, value) -> list[int]:
        """As ``try_find``; LookupError where no element equals it."""
        found = self.try_find(value)
        if found is None:
            raise LookupError(value)
        return found

    def linear_to_idx(self, line: int) -> list[int]:
        """Indices of a row-major position."""
        if not 0 <= line < self.n_elems:
            raise IndexError(line)
        out: list[int] = []
        for n in reversed(self.shape):
            out.insert(0, line % n)
            line //= n
        return out

    def idx_to_linear(self, index: Sequence[int]) -> int:
        line = 0
        for i, n in zip(index, self.shape, strict=True):
            if not 0 <= i < n:
                raise IndexError(index)
            line = line * n + i
        return line

    def set_element(self, index: Sequence[int], value) -> TensorFrame:
        """This tensor with one element replaced."""
        self.idx_to_linear(index)
        return self.set_slice(list(index), value)

    def _by_axis(self, axis: int, value: Column) -> TensorFrame:
        others = [f"i{k}" for k in range(self.n_dims) if k != axis]
        df = self.df.groupBy(*others).agg(value.alias("v"))
        return TensorFrame(df.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(others)), "v"), [s for k, s in enumerate(self.shape) if k != axis])

    def fold_axis(self, axis: int, start: Column, step: Callable[[Column, Column], Column]) -> TensorFrame:
        """A user fold in index order; each group's values are gathered, so an axis must fit in a task."""
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"i{axis}").alias("at"), F.col("v").alias("v")))), lambda x: x["v"])
        return self._by_axis(axis, F.aggregate(ordered, start, step))

    def trace(self) -> TensorFrame:
        return self.trace_axis(self.n_dims - 2, self.n_dims - 1)

    def trace_axis(self, a: int, b: int) -> TensorFrame:
        """Sums over the diagonal of two axes."""
        return self.diag_axis(a, b).reduce("sum", min(a, b))

    def diff_axis(self, axis: int) -> TensorFrame:
        """a[i+1] - a[i]; the axis is one shorter.  Windows run over blocks of the axis, each with the next block's first element."""
        at, shape = F.col(f"i{axis}"), list(self.shape)
        shape[axis] = max(0, shape[axis] - 1)
        block = _div(at, DIFF_BLOCK)
        spread = F.when((at > 0) & (at % DIFF_BLOCK == 0), F.array(block, block - 1)).otherwise(F.array(block))
        rows = self.df.withColumn("_block", F.explode(spread))
        w = Window.partitionBy(*[f"i{k}" for k in range(self.n_dims) if k != axis], "_block").orderBy(f"i{axis}")
        step = scalar.binary("subtract", F.lead("v").over(w), F.col("v"), self.dtype)
        return TensorFrame(rows.withColumn("v", step).where((F.col(f"i{axis}") < shape[axis]) & (_div(F.col(f"i{axis}"), DIFF_BLOCK) == F.col("_block"))), shape)

    def diff(self) -> TensorFrame:
        return self.diff_axis(self.n_dims - 1)

    # -- masks, gather, scatter --------------------------------------------------------------------------------------
    def masked(self, masks: Sequence[TensorFrame | None]) -> TensorFrame:
        """Elements where the masks are true.  A mask of rank r takes the next r axes and makes one axis of its trues, in
        row-major order; None leaves one axis as it is; axes after the last mask stay.  Counts trues (an action)."""
        out, columns, shape, axis = self.df, [], [], 0
        for k, mask in enumerate(masks):
            if mask is None:
                columns.append(F.col(f"i{axis}")), shape.append(self.shape[axis])
                axis += 1
                continue
            own = self.shape[axis : axis + mask.n_dims]
            if not mask.n_dims or mask.shape != own:
                raise ValueError(f"a mask of {mask.shape} for axes of {own}")
            kept, count = _numbered(mask.df.where("v").select(*(F.col(f"i{d}").alias(f"i{axis + d}") for d in range(mask.n_dims))), [f"i{axis + d}" for d in range(mask.n_dims)])
            kept = kept.withColumnRenamed("n", f"_m{k}")
            out = out.join(F.broadcast(kept) if count <= BROADCAST_ELEMENTS else kept, [f"i{axis + d}" for d in range(mask.n_dims)])
            columns.append(F.col(f"_m{k}")), shape.append(count)
            axis += mask.n_dims
        columns += [F.col(f"i{k}") for k in range(axis, self.n_dims)]
        shape += self.shape[axis:]
        return TensorFrame(out.select(*(c.alias(f"i{j}") for j, c in enumerate(columns)), "v"), shape)

    def set_masked(self, mask: TensorFrame | Sequence[TensorFrame | None], value) -> TensorFrame:
        """Elements where a mask of this shape (or masks of the axes, as in ``masked``) are true, replaced by a number or by
        a tensor that broadcasts to what ``masked`` gives there, in row-major order."""
        masks = [mask] if isinstance(mask, TensorFrame) else list(mask)
        if isinstance(mask, TensorFrame) and mask.shape != self.shape:
            raise ValueError("a mask needs the tensor's shape")
        if not isinstance(value, TensorFrame) and isinstance(mask, TensorFrame):
            return self.map2(mask, lambda v, m: F.when(m, F.lit(value)).otherwise(v))
        places = self.mapi(lambda *x: F.struct(*(c.alias(f"o{d}") for d, c in enumerate(x[:-1])))).masked(masks)
        if isinstance(value, TensorFrame):
            placed = places.map2(value.broadcast_to(places.shape), lambda at, w: F.struct(at.alias("at"), w.alias("w")))
        else:
            placed = places.map(lambda at: F.struct(at.alias("at"), F.lit(value).alias("w")))
        filled = placed.df.select(*(F.col(f"v.at.o{d}").alias(f"i{d}") for d in range(self.n_dims)), F.col("v.w").alias("w"), F.lit(True).alias("hit"))
        return TensorFrame(self.df.join(filled, _i(self.n_dims), "left").withColumn("v", F.when(F.col("hit"), F.col("w")).otherwise(F.col("v"))), self.shape)

    def true_idx(self) -> TensorFrame:
        """[count of trues, rank] table of the indices of true elements, in row-major order."""
        table, count = _numbered(self.df.where("v").select(*_i(self.n_dims)), _i(self.n_dims))
        rows = table.select("n", F.posexplode(F.array(*_i(self.n_dims))).alias("k", "v"))
        return TensorFrame(rows.select(F.col("n").alias("i0"), F.col("k").cast("long").alias("i1"), "v"), (count, self.n_dims))

    def gather(self, indices: Sequence[TensorFrame | None]) -> TensorFrame:
        """out[i] = self[indices[0][i], ...]; None stands for the output's own index on that axis."""
        given = [t for t in indices if t is not None]
        if not given or any(t is None for t in list(indices)[len(indices) - len(given) :]):
            raise ValueError("at least one index tensor is needed, and None only stands for leading axes")
        rank = given[0].n_dims
        if any(t.shape != given[0].shape for t in given):
            raise ValueError("index tensors need one shape")
        at = given[0].df.select(*_i(rank), F.col("v").alias("g0"))
        for k, t in enumerate(given[1:], 1):
            at = at.join(t.df.select(*_i(rank), F.col("v").alias(f"g{k}")), _i(rank))
        source = self.df.select(*(F.col(f"i{k}").alias(f"s{k}") for k in range(self.n_dims)), "v")
        j, on = 0, F.lit(True)
        for k, t in enumerate(indices):
            on &= F.col(f"s{k}") == (F.col(f"i{k}") if t is None else F.col(f"g{j}"))
            j += t is not None
        missing = F.raise_error(F.lit("a gather index out of range"))
        found = at.join(source.withColumn("hit", F.lit(True)), on, "left").withColumn("v", F.when(F.col("hit"), F.col("v")).otherwise(missing.cast(self.dtype)))
        return TensorFrame(found, given[0].shape)

    def scatter(self, indices: Sequence[TensorFrame | None], shape: Sequence[int]) -> TensorFrame:
        """out[indices[0][i], ...] += self[i]; elsewhere zero."""
        at = self.df
        targets = []
        for k, t in enumerate(indices):
            if t is None:
                targets.append(F.col(f"i{k}"))
            else:
                at = at.join(t.df.select(*_i(self.n_dims), F.col("v").alias(f"t{k}")), _i(self.n_dims))
                targets.append(F.col(f"t{k}"))
        inside = fold(lambda a, b: a & b, (t.between(0, n - 1) for t, n in zip(targets, shape, strict=True)), F.lit(True))
        checked = at.withColumn("v", F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit("a scatter index out of range")).cast(self.dtype)))
        sums = checked.groupBy(*(t.alias(f"i{k}") for k, t in enumerate(targets))).agg(F.sum("v").alias("w"))
        return TensorFrame.init(self.spark, shape, lambda *i: F.lit(0))._zero_filled(sums, self.dtype)

    def _zero_filled(self, sums: DataFrame, kind: str) -> TensorFrame:
        full = self.df.drop("v").join(sums, _i(self.n_dims), "left") if self.n_dims else sums
        return TensorFrame(full.withColumn("v", F.coalesce("w", F.lit(0)).cast(kind)), self.shape)

    # -- products ----------------------------------------------------------------------------------------------------
    def dot(self, other: TensorFrame) -> TensorFrame:
        """vec·vec, mat·vec, mat·mat and batches of the latter two (equal leading axes or size 1)."""
        if self.n_dims == 1 and other.n_dims == 1:
            return (self * other).sum()
        if self.n_dims == 1:
            return self.pad_left().dot(other).cut_left() if other.n_dims == 2 else NotImplemented
        if other.n_dims == self.n_dims - 1:
            return self.dot(other.pad_right()).cut_right()
        r = self.n_dims
        if other.n_dims != r or self.shape[-1] != other.shape[-2]:
            raise ValueError(f"cannot multiply {self.shape} by {other.shape}")
        batch = [max(x, y) if 0 not in (x, y) else 0 for x, y in zip(self.shape[:-2], other.shape[:-2], strict=True)]
        a, b = self.broadcast_to([*batch, *self.shape[-2:]]), other.broadcast_to([*batch, *other.shape[-2:]])
        keys = _i(r - 2)
        if math.prod(batch) * self.shape[-2] * self.shape[-1] * other.shape[-1] > TILED_PRODUCTS and self.dtype not in BITS and other.dtype not in BITS:
            return a._tiled_dot(b)
        left = a.df.select(*keys, F.col(f"i{r - 2}").alias("row"), F.col(f"i{r - 1}").alias("k"), F.col("v").alias("x"))
        right = b.df.select(*keys, F.col(f"i{r - 2}").alias("k"), F.col(f"i{r - 1}").alias("col"), F.col("v").alias("y"))
        if min(a.n_elems, b.n_elems) <= BROADCAST_ELEMENTS:
            left, right = (left, F.broadcast(right)) if b.n_elems <= a.n_elems else (F.broadcast(left), right)
        sums = left.join(right, [*keys, "k"]).groupBy(*keys, "row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
        return TensorFrame(sums.select(*keys, F.col("row").alias(f"i{r - 2}"), F.col("col").alias(f"i{r - 1}"), "v"), [*batch, self.shape[-2], other.shape[-1]])

    def _tiled_dot(self, other: TensorFrame) -> TensorFrame:
        """Products of tiles with numpy, summed over the tiles of the shared axis.

        A tile is TILE elements long on each side; a tile of the left matrix goes to every column of tiles, and one of the
        right matrix to every row of tiles, so a task holds three tiles, and what is summed up is a partial result per tile
        of the shared axis instead of every single product.
        """
        r = self.n_dims
        keys, (m, k), n = _i(r - 2), self.shape[-2:], other.shape[-1]
        # The shared axis is cut finer where the result is small, as its partial sums are cheap then.
        deep = TILE if m * n >= TILE * TILE else max(TILE, min(16 * TILE, TILE * TILE * 4 // max(m, n, 1)))
        tiles = lambda size, length: -(-size // length)
        spread = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(tiles(size, TILE), 1) - 1).cast("long")))
        i, j = F.col(f"i{r - 2}"), F.col(f"i{r - 1}")
        left = self.df.select(*keys, _div(i, TILE).alias("ti"), spread(n).alias("tj"), _div(j, deep).alias("tk"), (i % TILE).alias("p"), (j % deep).alias("q"), F.col("v").cast("double").alias("x"))
        right = other.df.select(*keys, spread(m).alias("ti"), _div(j, TILE).alias("tj"), _div(i, deep).alias("tk"), (i % deep).alias("p"), (j % TILE).alias("q"), F.col("v").cast("double").alias("x"))
        on = [*keys, "ti", "tj", "tk"]

        def multiply(key, a, b):
            import pandas as pd

            *lead, ti, tj, tk = key
            x = np.zeros((min(TILE, m - ti * TILE), min(deep, k - tk * deep)))
            y = np.zeros((x.shape[1], min(TILE, n - tj * TILE)))
            x[a["p"], a["q"]] = a["x"]
            y[b["p"], b["q"]] = b["x"]
            out = x @ y
            rows, columns = np.indices(out.shape).reshape(2, -1)
            made = {c: np.full(out.size, v, np.int64) for c, v in zip(keys, lead, strict=True)}
            return pd.DataFrame(made | {f"i{r - 2}": rows + ti * TILE, f"i{r - 1}": columns + tj * TILE, "v": out.reshape(-1)})

        schema = ", ".join([*(f"i{d} long" for d in range(r)), "v double"])
        parts = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(multiply, schema)
        sums = parts.groupBy(*_i(r)).agg(F.sum("v").alias("v")) if tiles(k, deep) > 1 else parts
        return TensorFrame(sums, [*self.shape[:-1], n])

    def dot_trace(self, other: TensorFrame) -> TensorFrame:
        """The trace of the product of two matrices (or batches): one multiplication and one sum, without the product."""
        return (self * other.transpose()).reduce("sum", self.n_dims - 1).reduce("sum", self.n_dims - 2)

    def tensor_product(self, other: TensorFrame) -> TensorFrame:
        """Kronecker product: axis sizes multiply."""
        n = max(self.n_dims, other.n_dims)
        a, b = self.at_least_nd(n), other.at_least_nd(n)
        if min(a.n_elems, b.n_elems) > BROADCAST_ELEMENTS:
            raise ValueError(f"the product of {self.shape} and {other.shape} would have {a.n_elems * b.n_elems} elements: one side must be small")
        right = b.df.select(*(F.col(f"i{k}").alias(f"j{k}") for k in range(n)), F.col("v").alias("w"))
        both = a.df.crossJoin(F.broadcast(right)) if b.n_elems <= BROADCAST_ELEMENTS else F.broadcast(a.df).crossJoin(right)
        return TensorFrame(both.select(*((F.col(f"i{k}") * b.shape[k] + F.col(f"j{k}")).alias(f"i{k}") for k in range(n)), (F.col("v") * F.col("w")).alias("v")), [x * y for x, y in zip(a.shape, b.shape, strict=True)])

    # -- putting together --------------------------------------------------------------------------------------------
    @staticmethod
    def concat(axis: int, parts: Sequence[TensorFrame]) -> TensorFrame:
        frames, at = [], 0
        for t in parts:
            if [s for k, s in enumerate(t.shape) if k != axis] != [s for k, s in enumerate(parts[0].shape) if k != axis]:
                raise ValueError("the other axes must be equal")
            frames.append(t.df.withColumn(f"i{axis}", F.col(f"i{axis}") + at))
            at += t.shape[axis]
        shape = list(parts[0].shape)
        shape[axis] = at
        return TensorFrame(fold(DataFrame.unionByName, frames), shape)

    @staticmethod
    def of_blocks(blocks) -> TensorFrame:
        """Nested lists of tensors put together, the outermost list along the first axis."""

        def build(x, axis):
            return x if isinstance(x, TensorFrame) else TensorFrame.concat(axis, [build(y, axis + 1) for y in x])

        return build(blocks, 0)

    def replicate(self, axis: int, times: int) -> TensorFrame:
        n = self.shape[axis]
        spread = self.df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(f"i{axis}", F.col("_r") * n + F.col(f"i{axis}"))
        shape = list(self.shape)
        shape[axis] = n * times
        return TensorFrame(spread, shape)

    def replicate_to(self, axis: int, size: int) -> TensorFrame:
        return self.replicate(axis, -(-size // self.shape[axis])).slice(*[ALL] * axis, (0, size - 1))

    @staticmethod
    def build(spark: SparkSession, shape: Sequence[int], parts: Sequence[tuple[Sequence[int], TensorFrame]]) -> TensorFrame:
        """Parts placed at offsets in a tensor of zeros."""
        rows = [t.df.select(*((F.col(f"i{k}") + a).alias(f"i{k}") for k, a in enumerate(at)), F.col("v").alias("w")) for at, t in parts]
        return TensorFrame.init(spark, shape, lambda *i: F.lit(0))._zero_filled(fold(DataFrame.unionByName, rows), parts[0][1].dtype)


def covariance_matrix(kernel: Callable[[Column, Column], Column], a: TensorFrame, b: TensorFrame) -> TensorFrame:
    """kernel(a[i], b[j]) for all pairs of elements of two vectors; one of them must be small enough to be broadcast."""
    if a.n_dims != 1 or b.n_dims != 1:
        raise ValueError("a covariance matrix is of two vectors")
    if min(a.n_elems, b.n_elems) > BROADCAST_ELEMENTS:
        raise ValueError(f"{a.n_elems} by {b.n_elems} pairs: one side must be small")
    x, y = a.df.select("i0", F.col("v").alias("x")), b.df.select(F.col("i0").alias("i1"), F.col("v").alias("y"))
    both = x.crossJoin(F.broadcast(y)) if b.n_elems <= a.n_elems else F.broadcast(x).crossJoin(y)
    return TensorFrame(both.select("i0", "i1", kernel(F.col("x"), F.col("y")).alias("v")), (a.n_elems, b.n_elems))


def broadcast_to_same(*tensors: TensorFrame, dims: Sequence[int] | None = None) -> list[TensorFrame]:
    """Tensors of one rank and, on all axes or some, of one size: missing axes are added on the left, sizes of 1 repeated."""
    n = max(t.n_dims for t in tensors)
    padded = [t.at_least_nd(n) for t in tensors]
    shapes = [list(t.shape) for t in padded]
    for k in range(n) if dims is None else dims:
        sizes = {s[k] for s in shapes} - {1}
        if len(sizes) > 1:
            raise ValueError(f"axis {k} has sizes {sorted(sizes)}")
        for s in shapes:
            s[k] = next(iter(sizes), 1)
    return [t.broadcast_to(s) for t, s in zip(padded, shapes, strict=True)]


def _div(c: Column, n: int) -> Column:
    """Whole-number division of a long index that is not negative."""
    return c if n == 1 else ((c - c % n) / n).cast("long")


#: Rows that one task numbers, until there are so many buckets.
BUCKET_ROWS, MAX_BUCKETS, PER_BUCKET = 250_000, 4096, 32


def _numbered(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with a dense 0-based number ``n`` in the order of some columns, and how many they are (actions).

    Each row's bucket is a function of the row's values alone, the number of bounds that aren't above its key, so it is the
    same wherever and whenever it is computed; bounds come from a sample of keys chosen by their hash.  Buckets are counted
    first, and then each row's number is its rank in its bucket after the rows of all buckets before.  Ties go by a hash of
    the whole row, so only rows that are equal throughout have no order of their own, and no key, however frequent, is one
    task's work unless its rows are equal.
    """
    plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    key = F.struct(*(F.col(c).alias(f"k{j}") for j, c in enumerate(order)), F.xxhash64(*plain).alias("h"))
    total = df.count()
    buckets = min(MAX_BUCKETS, total // BUCKET_ROWS + 1)
    keyed = df.withColumn("_key", key)
    if buckets == 1:
        out, before = keyed.withColumn("_b", F.lit(0)), [0]
    else:
        every = max(1, total // (buckets * PER_BUCKET))
        sample = [r["_key"] for r in keyed.where(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).select("_key").distinct().orderBy("_key").collect()]
        kinds = [f.dataType for f in keyed.schema["_key"].dataType]
        bounds = [sample[k * len(sample) // buckets] for k in range(1, buckets)] if len(sample) >= buckets else sample
        literal = lambda row: F.struct(*(F.lit(v).cast(t).alias(f"k{j}" if j < len(order) else "h") for j, (v, t) in enumerate(zip(row, kinds, strict=True))))
        # Two levels, so that a row is compared with the square root of the bounds.
        step = max(1, math.isqrt(len(bounds)))
        below = lambda found, k: F.size(F.filter(found, lambda bound: bound <= k))
        coarse = F.array(*(literal(bounds[j]) for j in range(0, len(bounds), step)))
        fine = F.array(*(F.array(*map(literal, bounds[j : j + step])) for j in range(0, len(bounds), step)))
        at = keyed.withColumn("_c", below(coarse, F.col("_key")))
        out = at.withColumn("_b", F.when(F.col("_c") == 0, 0).otherwise((F.col("_c") - 1) * step + below(F.get(fine, F.col("_c") - 1), F.col("_key")))).drop("_c")
        many = {r["_b"]: r["count"] for r in out.groupBy("_b").count().collect()}
        before = [0]
        for k in range(len(bounds)):
            before.append(before[-1] + many.get(k, 0))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_key"))
    return out.withColumn("n", F.get(F.array(*(F.lit(x).cast("long") for x in before)), F.col("_b")) + rank - 1).drop("_key", "_b"), total


def _aggregate(name: str, v: Column, kind: str, n: int, options: dict) -> tuple[Column, str]:
    """An aggregate with its identity on an empty axis, and its type."""
    real = kind in ("double", "float")
    d = v.cast("double")
    known = F.when(~F.isnan(d), v) if real else v
    if name == "sum":
        return (scalar.sum_of_parts(scalar.sum_parts(v), kind) if kind in BITS else F.coalesce(F.sum(v), F.lit(0))), kind
    if name == "product":
        if kind in BITS:
            return F.aggregate(F.collect_list(v), F.lit(1).cast(kind), lambda a, x: scalar.binary("multiply", a, x, kind)), kind
        return F.coalesce(F.product(v), F.lit(1.0)), kind
    if name in ("min", "max"):
        low, high = (F.lit(x).cast(kind) for x in scalar.limits(kind))
        if name == "min":
            return F.least(F.coalesce(F.min(known), high), high), kind
        return F.greatest(F.coalesce(F.max(known), low), low), kind
    if name == "all":
        return F.coalesce(F.bool_and(v), F.lit(True)), "boolean"
    if name == "any":
        return F.coalesce(F.bool_or(v), F.lit(False)), "boolean"
    if name == "count_true":
        return F.count_if(v), "bigint"
    if name == "mean":
        if not real:
            return F.call_function("div", scalar.sum_of_parts(scalar.sum_parts(v), kind), F.count(v)), kind
        return (F.avg(v) if n else F.lit(float("nan"))), kind
    if name in ("var", "std"):
        ddof = options.get("ddof", 0)
        var = F.var_pop(v) if not ddof else divide(F.var_pop(v) * n, F.lit(n - ddof))
        return (var if name == "var" else F.sqrt(var)), "double"
    if name == "norm":
        order = float(options.get("ord", 2))
        return F.pow(F.coalesce(F.sum(F.pow(d, F.lit(order))), F.lit(0.0)), F.lit(1 / order)), "double"
    raise ValueError(f"no reduction {name}")
