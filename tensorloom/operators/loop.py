"""Loops over sequences with derivatives through all their iterations, and draws from distributions.

Sequences are sorted within partitions and streamed through Arrow in order; what a loop carries along is its channels'
last few states, so a sequence may be of any length and the work grows with the rows.  The backward pass is a stream in the
opposite order that carries slopes instead.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.frame import TensorFrame
from tensorloom.plans import expr as E
from tensorloom.plans import tensor as T

ITERATION, REMAINING = "iteration", "remaining"
_ROWS = 2000


def previous(channel: str, delay: int = 1, shape: Sequence[int] | None = None):
    """The state of a channel some iterations before; with a shape, for channels of tensors."""
    name = f"{channel}@{delay}"
    return E.var(name) if shape is None else T.var(name, shape)


class _Step:
    """One channel's step: its value, and slopes by its variables for a given slope of the value."""

    def __init__(self, step: E.Expr | T.Tensor):
        self.tensor = isinstance(step, T.Tensor)
        if self.tensor:
            self.shapes = {n: v.shape for n, v in step.variables().items()}
            self.names = sorted(self.shapes)
            back = T.total(step * T.var("_slope", step.shape)).gradient(self.names)
            self.roots, self.back = [step], [back[n] for n in self.names]
        else:
            self.names = sorted(step.variables())
            self.shapes = dict.fromkeys(self.names, ())
            slopes = step.gradient(self.names)
            self.run, self.slopes = step.compiled(self.names), [slopes[n].compiled(self.names) for n in self.names]

    def value(self, bind: Mapping[str, object]):
        return T.values(self.roots, bind)[0] if self.tensor else self.run(*[bind[n] for n in self.names])

    def backward(self, bind: Mapping[str, object], slope) -> list:
        if self.tensor:
            return T.values(self.back, {**bind, "_slope": slope})
        xs = [bind[n] for n in self.names]
        return [slope * f(*xs) for f in self.slopes]


@dataclass(frozen=True)
class Channels:
    """state_c[k] = steps[c](earlier states, columns, parameters, iteration, remaining) along each sequence.

    Steps are scalar expressions, or tensor expressions over columns of arrays.  Their variables are ``previous`` states of
    any channel, names of columns, names of parameters, and ``iteration`` and ``remaining``, which count from and to 0.
    ``initial`` has each channel's states before the first iteration, the newest last: as many as its longest delay.
    A sequence's order should be unique; a null in a column that a step reads is an error.
    """

    steps: Mapping[str, E.Expr | T.Tensor]
    key: str
    order: Sequence[str]
    initial: Mapping[str, Sequence] = field(default_factory=dict)

    def _delays(self) -> dict[str, int]:
        """The longest delay of each channel that is read."""
        out: dict[str, int] = {}
        for step in self.steps.values():
            for n in step.variables():
                channel, _, delay = n.rpartition("@")
                if channel:
                    if channel not in self.steps or int(delay) < 1:
                        raise ValueError(f"no channel for {n}")
                    out[channel] = max(out.get(channel, 0), int(delay))
        for c, n in out.items():
            if len(self.initial.get(c, ())) < n:
                raise ValueError(f"{c} needs {n} initial states")
        return out

    def _columns(self, df: DataFrame, parameters: Mapping) -> list[str]:
        names = {n for s in self.steps.values() for n in s.variables() if "@" not in n and n not in parameters}
        missing = names - {*df.columns, ITERATION, REMAINING}
        if missing:
            raise ValueError(f"neither columns nor parameters: {sorted(missing)}")
        return sorted(names - {ITERATION, REMAINING})

    def _sorted(self, df: DataFrame, parameters: Mapping, descending: bool = False) -> DataFrame:
        if any(REMAINING in s.variables() or descending for s in self.steps.values()):
            counts = df.groupBy(self.key).agg(F.count(F.lit(1)).alias("_length"))
            df = df.join(counts.withColumnRenamed(self.key, "_counted"), F.col(self.key).eqNullSafe(F.col("_counted"))).drop("_counted")
        else:
            df = df.withColumn("_length", F.lit(0).cast("long"))
        order = [F.col(c).desc() if descending else F.col(c) for c in self.order]
        return df.repartition(self.key).sortWithinPartitions(self.key, *order)

    def _kind(self, channel: str) -> str:
        return "array<double>" if isinstance(self.steps[channel], T.Tensor) else "double"

    def states(self, df: DataFrame, parameters: Mapping = {}, out: Mapping[str, str] | None = None, before: bool = False) -> DataFrame:
        """Every row with its states: a column for each channel (``out`` renames them); ``before``: the read states too."""
        named = {c: (out or {}).get(c, c) for c in self.steps}
        delays, columns = self._delays(), self._columns(df, parameters)
        steps, key = {c: _Step(s) for c, s in self.steps.items()}, self.key
        read = sorted({n for s in steps.values() for n in s.names if "@" in n})
        shapes = {n: shape for s in steps.values() for n, shape in s.shapes.items()}
        initial = {c: [np.asarray(x, float) if steps[c].tensor else float(x) for x in self.initial[c]] for c in delays}
        rows = self._sorted(df, parameters)
        extra = {**{named[c]: self._kind(c) for c in self.steps}, **({f"_{n}": self._kind(n.rpartition("@")[0]) for n in read} if before else {})}
        keep = [f for f in df.schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, k, past = _NOTHING, 0, {}
            for whole in batches:
                for lo in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(lo, _ROWS)
                    made: dict[str, list] = {n: [] for n in extra}
                    keys, lengths = batch.column(batch.schema.get_field_index(key)).to_pylist(), batch.column(batch.schema.get_field_index("_length")).to_pylist()
                    data = {c: _cells(batch, c, shapes[c]) for c in columns}
                    for r, own in enumerate(keys):
                        if own != at:
                            at, k = own, 0
                            past = {c: deque(initial[c], maxlen=len(initial[c])) for c in delays}
                        bind = {**parameters, **{c: data[c][r] for c in columns}, ITERATION: float(k), REMAINING: float(lengths[r] - 1 - k)}
                        bind |= {n: past[n.rpartition("@")[0]][-int(n.rpartition("@")[2])] for n in read}
                        new = {c: s.value(bind) for c, s in steps.items()}
                        for c in delays:
                            past[c].append(new[c])
                        k += 1
                        for c, x in new.items():
                            made[named[c]].append(_plain(x))
                        if before:
                            for n in read:
                                made[f"_{n}"].append(_plain(bind[n]))
                    kept = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(made[n], _arrow(kind)) for n, kind in extra.items())], names=[*(f.name for f in keep), *extra])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"`{n}` {kind}" for n, kind in extra.items())])
        return rows.mapInArrow(run, schema)

    def adjoints(self, df: DataFrame, seeds: Mapping[str, str], parameters: Mapping = {}) -> DataFrame:
        """Every row with slopes of the sum of seed * state over all rows; ``seeds`` names a column for each seeded channel.

        ``d_<channel>`` by the row's state; ``d_<name>`` by a column's cell, and the row's part of the slope by a parameter,
        to be summed; ``d_initial_<channel>``: the row's part by the channel's initial states, an array, oldest first.
        """
        delays, columns = self._delays(), self._columns(df, parameters)
        steps, key = {c: _Step(s) for c, s in self.steps.items()}, self.key
        shapes = {n: shape for s in steps.values() for n, shape in s.shapes.items()}
        read = sorted(n for n in shapes if "@" in n)
        rows = self._sorted(self.states(df, parameters, {c: f"_state_{c}" for c in steps}, before=True), parameters, descending=True)
        sizes = {c: len(self.initial[c]) for c in delays}
        wanted = [*columns, *(p for p in parameters if p in shapes)]
        kinds = {f"d_{c}": self._kind(c) for c in steps} | {f"d_{n}": "array<double>" if shapes[n] else "double" for n in wanted} | {f"d_initial_{c}": "array<double>" for c in delays}
        keep = [f for f in df.schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, k, coming = _NOTHING, 0, {}
            for whole in batches:
                for lo in range(0, whole.num_rows, _ROWS):
                    batch = whole.slice(lo, _ROWS)
                    made: dict[str, list] = {n: [] for n in kinds}
                    keys, lengths = batch.column(batch.schema.get_field_index(key)).to_pylist(), batch.column(batch.schema.get_field_index("_length")).to_pylist()
                    data = {c: _cells(batch, c, shapes[c]) for c in columns} | {n: _cells(batch, f"_{n}", shapes[n]) for n in read}
                    seed = {c: _cells(batch, col, np.shape(self.initial[c][0]) if steps[c].tensor and c in self.initial else (-1,) if steps[c].tensor else ()) for c, col in seeds.items()}
                    for r, own in enumerate(keys):
                        if own != at:
                            at, k = own, lengths[r] - 1
                            coming = defaultdict(dict)  # of each channel, slopes by the states of iterations still to come
                        bind = {**parameters, **{n: data[n][r] for n in data}, ITERATION: float(k), REMAINING: float(lengths[r] - 1 - k)}
                        parts: dict[str, object] = defaultdict(float)
                        first = {c: [0.0] * sizes[c] for c in delays}
                        slopes = {}
                        for c in steps:
                            slopes[c] = coming[c].pop(k, 0.0) + (seed[c][r] if c in seed else 0.0)
                        for c, s in steps.items():
                            if not np.any(slopes[c]):
                                continue
                            for n, d in zip(s.names, s.backward(bind, slopes[c]), strict=True):
                                channel, _, delay = n.rpartition("@")
                                if not channel:
                                    parts[n] = parts[n] + d
                                elif k - int(delay) >= 0:
                                    coming[channel][k - int(delay)] = coming[channel].get(k - int(delay), 0.0) + d
                                else:
                                    first[channel][sizes[channel] + k - int(delay)] += d
                        k -= 1
                        for c in steps:
                            made[f"d_{c}"].append(_plain(slopes[c] if not steps[c].tensor or np.ndim(slopes[c]) else np.zeros(self.steps[c].shape)))
                        for n in wanted:
                            made[f"d_{n}"].append(_plain(parts[n] if not shapes[n] or np.ndim(parts[n]) else np.zeros(shapes[n])))
                        for c in delays:
                            size = self.steps[c].shape if steps[c].tensor else ()
                            made[f"d_initial_{c}"].append(np.concatenate([np.broadcast_to(x, size).reshape(-1) for x in first[c]]).tolist())
                    kept = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(made[n], _arrow(kind)) for n, kind in kinds.items())], names=[*(f.name for f in keep), *kinds])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"`{n}` {kind}" for n, kind in kinds.items())])
        return rows.mapInArrow(run, schema)

    def gradient(self, df: DataFrame, seeds: Mapping[str, str], parameters: Mapping = {}) -> dict[str, np.ndarray]:
        """Slopes by each parameter and by ``initial_<channel>``, summed over all rows."""
        rows = self.adjoints(df, seeds, parameters)
        names = [f"d_{n}" for n in [*parameters, *(f"initial_{c}" for c in self._delays())] if f"d_{n}" in rows.columns]
        cells = F.array(*(F.col(n) if rows.schema[n].dataType.simpleString().startswith("array") else F.array(n) for n in names))
        sums = rows.select(F.posexplode(cells).alias("name", "xs")).select("name", F.posexplode("xs").alias("k", "x")).groupBy("name", "k").agg(F.sum("x").alias("x")).orderBy("name", "k").collect()
        found = {n: np.array([r.x for r in sums if r.name == j]) for j, n in enumerate(names)}
        shaped = lambda n, x: x.reshape(np.shape(parameters[n])) if n in parameters else x
        return {n.removeprefix("d_"): shaped(n.removeprefix("d_"), x) for n, x in found.items()}


_NOTHING = object()


def _arrow(kind: str) -> pa.DataType:
    return pa.float64() if kind == "double" else pa.list_(pa.float64())


def _plain(x):
    return np.asarray(x, float).reshape(-1).tolist() if np.ndim(x) else float(x)


def _cells(batch: pa.RecordBatch, name: str, shape: tuple[int, ...]) -> list:
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        raise ValueError(f"{name} has nulls")
    return [np.asarray(x, float).reshape(shape) for x in column.to_pylist()] if shape else [float(x) for x in column.to_pylist()]


@dataclass(frozen=True)
class Loop:
    """state_k = step(state_{k-1}, value_k, parameters) along each sequence, from ``start``: ``Channels`` with one channel.

    ``step`` is an expression of the variables ``state``, ``value`` and the parameters' names.
    """

    step: E.Expr
    key: str
    order: Sequence[str]
    value: str
    start: float = 0.0

    def _channels(self) -> Channels:
        step = self.step.subst(E.var("state"), previous("state")).subst(E.var("value"), E.var(self.value))
        return Channels({"state": step}, self.key, self.order, {"state": [self.start]})

    def states(self, df: DataFrame, parameters: Mapping[str, float] = {}, out: str = "state") -> DataFrame:
        """Every row with its state."""
        return self._channels().states(df, parameters, {"state": out})

    def adjoints(self, df: DataFrame, seed: str, parameters: Mapping[str, float] = {}) -> DataFrame:
        """Every row with ``d_state`` and ``d_value``: slopes of the sum of seed * state by its state and its value.

        ``d_<name>`` is the row's part of a parameter's slope, and ``d_start`` that of the start, to be summed.
        """
        rows = self._channels().adjoints(df, {"state": seed}, parameters)
        made = {f"d_{n}": F.lit(0.0) for n in ["state", *parameters] if f"d_{n}" not in rows.columns}
        value = F.col(f"d_{self.value}") if f"d_{self.value}" in rows.columns else F.lit(0.0)
        start = F.get("d_initial_state", F.lit(0)) if "d_initial_state" in rows.columns else F.lit(0.0)
        drop = [c for c in ("d_initial_state", f"d_{self.value}") if c != "d_value"]
        return rows.withColumns({**made, "_dv": value, "d_start": start}).drop(*drop, "d_value").withColumnRenamed("_dv", "d_value")

    def gradient(self, df: DataFrame, seed: str, parameters: Mapping[str, float]) -> DataFrame:
        """One row with the slope by each parameter and by the start, over all sequences."""
        return self.adjoints(df, seed, parameters).agg(*(F.coalesce(F.sum(f"d_{n}"), F.lit(0.0)).alias(n) for n in [*parameters, "start"]))


def multivariate_normal(spark: SparkSession, n: int, mean: Sequence[float], covariance: np.ndarray, seed: int = 0) -> TensorFrame:
    """``n`` draws, one a row, from a normal distribution; a covariance may be singular but not indefinite."""
    mean, covariance = np.asarray(mean, float), np.asarray(covariance, float)
    values, vectors = np.linalg.eigh(covariance)
    if not np.allclose(covariance, covariance.T) or values.min(initial=0) < -1e-9 * max(1.0, values.max(initial=0)):
        raise ValueError("a covariance must be symmetric and not indefinite")
    root = vectors * np.sqrt(np.maximum(values, 0))
    d = len(mean)
    draws = spark.range(n).select(F.col("id").alias("i0"), *(F.randn(seed + k).alias(f"_z{k}") for k in range(d)))
    cells = F.array(*(sum((F.col(f"_z{k}") * float(root[j, k]) for k in range(d)), F.lit(float(mean[j]))) for j in range(d)))
    return TensorFrame(draws.select("i0", F.posexplode(cells).alias("i1", "v")).withColumn("i1", F.col("i1").cast("long")), (n, d))
