"""Scans over ordered sequences, contractions by index names, and table interpolation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.operators.frame import TensorFrame, _numbered


def scan(df: DataFrame, key: str, order: Sequence[str], value: str, start: Column, step: Callable[[Column, Column, Column], Column], out: str) -> DataFrame:
    """state_k = step(state_{k-1}, value_k, k) along each sequence; every row gets its state.

    A sequence is one array in a task, and its states are copied once a row, so it is for short sequences and steps that
    only Columns can express; ``loop.Channels`` streams sequences of any length, ``exponential_scan`` splits them.
    """
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"), F.struct(*(c for c in df.columns)).alias("_row")))).alias("_rows"))
    first = F.struct(start.alias("s"), F.array().cast(f"array<{df.select(start.alias('s')).schema['s'].dataType.simpleString()}>").alias("all"), F.lit(0).cast("long").alias("k"))

    def merge(acc: Column, row: Column) -> Column:
        new = step(acc["s"], row["_v"], acc["k"])
        return F.struct(new.alias("s"), F.concat(acc["all"], F.array(new)).alias("all"), (acc["k"] + 1).alias("k"))

    states = F.aggregate("_rows", first, merge)["all"]
    zipped = rows.select(F.explode(F.arrays_zip(F.col("_rows").alias("r"), states.alias("s"))).alias("x"))
    return zipped.select("x.r._row.*", F.col("x.s").alias(out))


def exponential_scan(df: DataFrame, key: str, order: Sequence[str], value: str, decay: float, out: str, block: int = 64) -> DataFrame:
    """state_k = decay * state_{k-1} + value_k within blocks of rows, then over the blocks' ends, and over these blocks' ends.

    Rows are numbered through, so neither a long sequence nor its blocks are one task's work; no power of the decay is ever
    divided by, so small decays and 0 are exact.
    """
    rows, _ = _numbered(df, [key, *order])
    firsts = rows.groupBy(key).agg(F.min("n").alias("_first"), F.count(F.lit(1)).alias("_rows")).withColumnRenamed(key, "_of")
    longest = firsts.agg(F.max("_rows")).first()[0] or 0
    placed = rows.join(firsts.drop("_rows"), F.col(key).eqNullSafe(F.col("_of"))).withColumn("_k", F.col("n") - F.col("_first")).drop("n", "_first")
    return _decayed(placed, "_of", value, decay, out, block, longest).drop("_of", "_k")


def _decayed(rows: DataFrame, key: str, value: str, decay: float, out: str, block: int, longest: int) -> DataFrame:
    """``rows`` with positions _k from 0 in each sequence, and the decayed sums."""
    inner = Window.partitionBy(key, "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_b", F.floor(F.col("_k") / block)).withColumn("_r", F.col("_k") % block)
    own = F.aggregate(F.collect_list(F.col(value).cast("double")).over(inner), F.lit(0.0), lambda a, x: a * float(decay) + x)
    with_own = placed.withColumn("_own", own)
    if longest <= block:
        return with_own.withColumn(out, F.col("_own")).drop("_b", "_r", "_own")
    ends = with_own.groupBy(F.col(key).alias("_key"), F.col("_b").alias("_k")).agg(F.max_by("_own", "_r").alias("_end"))
    carried = _decayed(ends, "_key", "_end", decay**block, "_carry", block, -(-longest // block))
    # What a block ends with is carried into the next one.
    before = carried.select(F.col("_key").alias("_own_key"), (F.col("_k") + 1).alias("_next"), F.col("_carry").alias("_came"))
    both = with_own.join(before, F.col(key).eqNullSafe(F.col("_own_key")) & (F.col("_b") == F.col("_next")), "left")
    carry = F.coalesce("_came", F.lit(0.0)) * F.pow(F.lit(float(decay)), (F.col("_r") + 1).cast("double"))
    return both.withColumn(out, F.col("_own") + carry).drop("_b", "_r", "_own", "_own_key", "_next", "_came")


def contract(spec: str, a: TensorFrame, b: TensorFrame) -> TensorFrame:
    """Products of two tensors summed over the indices that the result lacks, as in ``"ij,jk->ik"``."""
    (left, right), result = spec.split("->")[0].split(","), spec.split("->")[1]
    sizes = dict(zip(left, a.shape, strict=True)) | dict(zip(right, b.shape, strict=True))
    x = a.df.select(*(F.col(f"i{k}").alias(c) for k, c in enumerate(left)), F.col("v").alias("_x"))
    y = b.df.select(*(F.col(f"i{k}").alias(c) for k, c in enumerate(right)), F.col("v").alias("_y"))
    shared = [c for c in left if c in right]
    both = x.join(y, shared) if shared else x.crossJoin(y)
    sums = both.groupBy(*result).agg(F.sum(F.col("_x") * F.col("_y")).alias("v"))
    return TensorFrame(sums.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(result)), "v"), [sizes[c] for c in result])


#: Elements of a table that is written into a plan; larger ones are broadcast by ``Interpolator.on``.
PLAN_TABLE, MAX_TABLE = 4096, 1_000_000


class Interpolator:
    """Linear interpolation in a small table over a box; outside it the nearest edge or zero.

    ``slopes``: tables of derivatives by axis, where they aren't to be the differences of this one.
    """

    def __init__(self, table: np.ndarray, low: Sequence[float], high: Sequence[float], outside: str = "nearest", to_left: bool = False, slopes: Mapping[int, Interpolator] | None = None):
        if table.size > MAX_TABLE:
            raise ValueError(f"a table of {table.size} elements is too large to be handed to every task")
        self.table, self.low, self.high, self.outside, self.to_left, self.slopes = np.asarray(table, float), low, high, outside, to_left, slopes or {}

    def __call__(self, *at: Column) -> Column:
        """The table at some Columns; a position at or beyond the last point counts as outside."""
        if self.table.size > PLAN_TABLE:
            raise ValueError("a large table isn't written into a plan: use on()")
        return self._at(F.array(*(F.lit(float(x)) for x in self.table.reshape(-1))), at)

    def on(self, df: DataFrame, out: str, *at: Column) -> DataFrame:
        """``df`` with the table at some Columns, from one broadcast copy of it."""
        row = df.sparkSession.createDataFrame([(self.table.reshape(-1).tolist(),)], "_table array<double>")
        return df.join(F.broadcast(row)).withColumn(out, self._at(F.col("_table"), at)).drop("_table")

    def _at(self, flat: Column, at: Sequence[Column]) -> Column:
        corners, inside = [(F.lit(0), F.lit(1.0))], F.lit(True)
        for c, n, lo, hi in zip(at, self.table.shape, self.low, self.high, strict=True):
            place = (c - lo) / ((hi - lo) / (n - 1))
            inside &= (place >= 0) & (place < n - 1)
            held = F.when(place < 0, 0.0).when(place > n - 1, float(n - 1)).otherwise(place)
            left = F.least(F.floor(held), F.lit(n - 1)).cast("int")
            right = F.least(left + 1, F.lit(n - 1))
            part = F.lit(0.0) if self.to_left else held - left
            corners = [(i * n + j, w * f) for i, w in corners for j, f in ([(left, 1 - part)] if self.to_left else [(left, 1 - part), (right, part)])]
        # One pass over the corners, so that the table stands in the expression once.
        terms = F.array(*(F.struct(i.cast("int").alias("i"), w.cast("double").alias("w")) for i, w in corners))
        total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.get(flat, t["i"]) * t["w"])
        return F.when(inside, total).otherwise(F.lit(0.0)) if self.outside == "zero" else total

    def derivative(self, axis: int) -> Interpolator:
        """The given table of slopes, or slopes between neighbouring points, constant to the left point, zero outside."""
        if axis in self.slopes:
            return self.slopes[axis]
        step = (self.high[axis] - self.low[axis]) / (self.table.shape[axis] - 1)
        last = [1 if k == axis else n for k, n in enumerate(self.table.shape)]
        slopes = np.zeros_like(self.table) if self.to_left else np.concatenate([np.diff(self.table, axis=axis) / step, np.zeros(last)], axis)
        return Interpolator(slopes, self.low, self.high, "zero", True)
