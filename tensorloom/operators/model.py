"""Models of named parameters: a builder, dense layers, perceptrons, and their training over frames of any size.

Parameters lie in one flat vector, which optimisers step and the driver keeps.  A step is one pass over the rows of its
batch: every partition evaluates loss and gradient of the model's expression over small groups of rows with numpy and gives
one row of sums, which Spark adds up by position, so what reaches the driver has the size of the model.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.plans import tensor as T
from tensorloom.sources.tensors import load_parameters, save_parameters

Init = Callable[[np.random.Generator, tuple[int, ...]], np.ndarray]


def zeros(rng: np.random.Generator, shape: tuple[int, ...]) -> np.ndarray:
    return np.zeros(shape)


class ModelBuilder:
    """Collects the parameters of a model, by name; ``module`` gives a builder whose names begin with the module's."""

    def __init__(self, prefix: str = "", found: dict[str, tuple[tuple[int, ...], Init]] | None = None):
        self.prefix, self.found = prefix, found if found is not None else {}

    def module(self, name: str) -> ModelBuilder:
        return ModelBuilder(f"{self.prefix}{name}.", self.found)

    def param(self, name: str, shape: Sequence[int], init: Init = zeros) -> T.Tensor:
        full = self.prefix + name
        if full in self.found and self.found[full][0] != tuple(shape):
            raise ValueError(f"{full} has shape {self.found[full][0]}")
        self.found.setdefault(full, (tuple(shape), init))
        return T.var(full, shape)

    def parameters(self) -> Parameters:
        return Parameters({n: s for n, (s, _) in self.found.items()}, {n: i for n, (_, i) in self.found.items()})


@dataclass
class Parameters:
    """Shapes of named parameters in one flat vector, in order of their names' first use."""

    shapes: dict[str, tuple[int, ...]]
    inits: dict[str, Init] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return sum(math.prod(s) for s in self.shapes.values())

    def start(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return self.pack({n: self.inits.get(n, zeros)(rng, s) for n, s in self.shapes.items()})

    def pack(self, values: dict[str, np.ndarray]) -> np.ndarray:
        for n, s in self.shapes.items():
            if np.shape(values[n]) != s:
                raise ValueError(f"{n} has shape {s}, not {np.shape(values[n])}")
        return np.concatenate([np.asarray(values[n], float).reshape(-1) for n in self.shapes]) if self.shapes else np.zeros(0)

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for n, s in self.shapes.items():
            size = math.prod(s)
            out[n] = flat[at : at + size].reshape(s)
            at += size
        return out

    def save(self, spark: SparkSession, flat: np.ndarray, path: str, mode: str = "errorifexists") -> None:
        save_parameters(spark, self.unpack(flat), path, mode)

    def load(self, spark: SparkSession, path: str) -> np.ndarray:
        return self.pack(load_parameters(spark, path))


# -- layers ----------------------------------------------------------------------------------------------------------
def dense(builder: ModelBuilder, x: T.Tensor, size: int, activation: str = "tanh") -> T.Tensor:
    """activation(x W' + b) for rows x; weights start between +-4 sqrt(6 / (in + out)), biases at 0."""
    inputs = x.shape[1]
    reach = 4 * math.sqrt(6 / (inputs + size))
    weights = builder.param("weights", (size, inputs), lambda rng, shape: rng.uniform(-reach, reach, shape))
    bias = builder.param("bias", (size,))
    return T.ACTIVATIONS[activation](x @ weights.T + T.insert_axis(bias, 0))


def perceptron(builder: ModelBuilder, x: T.Tensor, sizes: Sequence[int], activations: Sequence[str]) -> T.Tensor:
    """Dense layers behind each other."""
    for k, (size, activation) in enumerate(zip(sizes, activations, strict=True)):
        x = dense(builder.module(f"layer{k}"), x, size, activation)
    return x


def weight_penalty(parameters: Parameters, l1: float = 0.0, l2: float = 0.0) -> T.Tensor:
    """l1 times the absolute plus l2 times the squared weights of all layers; biases don't count."""
    out = T.const(0.0)
    for n, shape in parameters.shapes.items():
        if n.rpartition(".")[2] == "weights":
            w = T.var(n, shape)
            out = out + (l1 * T.lq(w, 1.0) if l1 else 0.0) + (l2 * T.total(w * w) if l2 else 0.0)
    return out


LOSSES = {"mse": T.mse, "binary_cross_entropy": T.binary_cross_entropy, "cross_entropy": T.cross_entropy, "softmax_cross_entropy": T.softmax_cross_entropy}


@dataclass(frozen=True)
class Perceptron:
    """A perceptron with its loss: ``prediction`` and ``loss`` are expressions for a number of rows ``n``.

    Variables: ``input`` [n, inputs], ``target`` [n, last size], and the parameters by name.
    """

    inputs: int
    sizes: tuple[int, ...]
    activations: tuple[str, ...]
    cost: str = "softmax_cross_entropy"
    l1: float = 0.0
    l2: float = 0.0

    def prediction(self, n: int, builder: ModelBuilder | None = None) -> T.Tensor:
        return perceptron(builder or ModelBuilder(), T.var("input", (n, self.inputs)), self.sizes, self.activations)

    @property
    def parameters(self) -> Parameters:
        builder = ModelBuilder()
        self.prediction(1, builder)
        return builder.parameters()

    def loss(self, n: int) -> T.Tensor:
        fit = LOSSES[self.cost](self.prediction(n), T.var("target", (n, self.sizes[-1])))
        return fit + weight_penalty(self.parameters, self.l1, self.l2) if self.l1 or self.l2 else fit

    def predict(self, df: DataFrame, flat: np.ndarray, column: str = "input", out: str = "prediction", rows: int = 256) -> DataFrame:
        """``df`` with the prediction for each row's array."""
        values = self.parameters.unpack(flat)

        def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for table in tables:
                x = np.stack(table[column].to_numpy()).astype(float) if len(table) else np.zeros((0, self.inputs))
                found = [self._expression(len(p)).value({**values, "input": p}) for p in np.split(x, range(rows, len(x), rows)) if len(p)]
                yield table.assign(**{out: list(np.concatenate(found)) if found else []})

        return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` array<double>"]))

    @lru_cache(maxsize=64)
    def _expression(self, n: int) -> T.Tensor:
        return self.prediction(n)


@lru_cache(maxsize=64)
def _with_gradient(model: Perceptron, n: int) -> tuple[list[str], list[T.Tensor]]:
    loss, names = model.loss(n), list(model.parameters.shapes)
    gradient = loss.gradient(names)
    return names, [loss, *(gradient[k] for k in names)]


def loss_and_gradient(model: Perceptron, df: DataFrame, flat: np.ndarray, columns: tuple[str, str] = ("input", "target"), rows: int = 256) -> tuple[float, np.ndarray]:
    """Mean loss over all rows and its gradient; (nan, zeros) without rows."""
    values = model.parameters.unpack(flat)

    def sums(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(len(flat) + 2)
        for table in tables:
            for at in range(0, len(table), rows):
                x, y = (np.stack(table[c].to_numpy()[at : at + rows]).astype(float) for c in columns)
                loss, *slopes = T.values(_with_gradient(model, len(x))[1], {**values, "input": x, "target": y})
                found += len(x) * np.concatenate([[1.0, float(loss)], *(s.reshape(-1) for s in slopes)])
        yield pd.DataFrame({"s": [found]})

    parts = df.select(*columns).mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(flat) + 2)
    for r in parts:
        out[r.k] = r.v
    return (out[1] / out[0], out[2:] / out[0]) if out[0] else (float("nan"), np.zeros(len(flat)))


# -- training --------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class TrainingPlan:
    #: Samples of a step; None: all of them.
    batch_size: int | None = None
    #: Learning rates, one after the other; each begins with the best parameters so far and a fresh optimiser.
    rates: tuple[float, ...] = (1e-3,)
    min_iterations: int = 0
    max_iterations: int = 1000
    #: A rate ends when the validation loss hasn't improved for so many iterations, by this part of the best loss at least.
    patience: int = 100
    gain: float = 1e-7
    target: float | None = None
    #: Losses of all parts are logged every so many iterations.
    log_every: int = 1
    #: A folder where the state is kept every so many iterations, and from which training goes on.
    checkpoint: str | None = None
    checkpoint_every: int = 20


@dataclass
class Trained:
    flat: np.ndarray
    #: (iteration, rate, losses of trn, val and tst)
    log: list[tuple[int, float, float, float, float]]
    best_iteration: int
    reason: str


def _keep(spark: SparkSession, folder: str, number: int, arrays: dict[str, np.ndarray], state: dict) -> None:
    path = f"{folder}/state-{number:09d}"
    save_parameters(spark, arrays, f"{path}/arrays", "overwrite")
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def _kept(spark: SparkSession, folder: str) -> tuple[dict[str, np.ndarray], dict] | None:
    """The newest state that was written to its end."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None
    names = sorted((f.getPath().getName() for f in system.listStatus(root)), reverse=True)
    for name in names:
        if system.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/state/_SUCCESS")):
            return load_parameters(spark, f"{folder}/{name}/arrays"), json.loads(spark.read.text(f"{folder}/{name}/state").first()[0])
    return None


def train(model: Perceptron, data: dict, optimizer, plan: TrainingPlan = TrainingPlan(), seed: int = 0) -> Trained:
    """Train over ``data``: datasets ``trn``, ``val`` and ``tst`` (``Dataset.split``) with array columns ``input`` and ``target``.

    A rate ends at its last iteration, without improvement, at the target loss, or at a loss that isn't finite.  Then the
    best parameters are restored, the log is cut back to the best iteration and the next rate begins.
    """
    spark = data["trn"].df.sparkSession
    parameters = model.parameters
    best = flat = parameters.start(seed)
    log: list[tuple[int, float, float, float, float]] = []
    best_loss, best_at, at, first_rate, since, reason = math.inf, 0, 0, 0, 0, ""
    resumed = _kept(spark, plan.checkpoint) if plan.checkpoint else None
    if resumed:
        arrays, state = resumed
        flat, best = arrays["flat"], arrays["best"]
        log = [tuple(x) for x in state["log"]]
        best_loss, best_at, at, first_rate, since = (state[k] for k in ("best_loss", "best_at", "at", "rate", "since"))
    batches = 1 if plan.batch_size is None else max(1, math.ceil(data["trn"].n_samples / plan.batch_size))
    for k in range(first_rate, len(plan.rates)):
        optimizer.rate = plan.rates[k]
        optimizer.reset()
        if resumed and k == first_rate:
            _restore(optimizer, arrays)
        else:
            flat, since, at = best, 0, best_at
            log = [row for row in log if row[0] < best_at]  # the best iteration is logged anew
        began = at
        while True:
            if at % plan.log_every == 0:
                losses = [loss_and_gradient(model, data[p].df, flat)[0] for p in ("trn", "val", "tst")]
                log.append((at, plan.rates[k], *losses))
                if not all(map(math.isfinite, losses)):
                    reason = "not finite"
                    break
                if losses[1] < best_loss - plan.gain * abs(best_loss if math.isfinite(best_loss) else 0.0):
                    best, best_loss, best_at, since = flat, losses[1], at, 0
                if plan.target is not None and losses[1] <= plan.target and at - began >= plan.min_iterations:
                    reason = "target reached"
                    break
                if since >= plan.patience and at - began >= plan.min_iterations:
                    reason = "no improvement"
                    break
            if at - began >= plan.max_iterations:
                reason = "iterations used up"
                break
            if plan.checkpoint and at > began and at % plan.checkpoint_every == 0:
                state = {"log": log, "best_loss": best_loss, "best_at": best_at, "at": at, "rate": k, "since": since}
                _keep(spark, plan.checkpoint, at + k * 10**6, {"flat": flat, "best": best, **_state(optimizer)}, state)
            part = data["trn"].df
            if batches > 1:
                low = at % batches * plan.batch_size
                part = part.where(F.col("sample_id").between(low, low + plan.batch_size - 1))
            flat = optimizer.step(flat, loss_and_gradient(model, part, flat)[1])
            at, since = at + 1, since + 1
        if reason == "target reached":
            break
    log = [row for row in log if row[0] <= best_at]
    return Trained(best, log, best_at, reason)


def _state(optimizer) -> dict[str, np.ndarray]:
    """What an optimiser remembers, as arrays."""
    own = getattr(optimizer, "state", None)
    if own is not None:
        return {f"state{k}": np.asarray(x, float) for k, x in enumerate(own)}
    return {"square": np.asarray(optimizer.square, float)} if hasattr(optimizer, "square") else {}


def _restore(optimizer, arrays: dict[str, np.ndarray]) -> None:
    if hasattr(optimizer, "state"):
        step, *rest = (arrays[f"state{k}"] for k in range(len(optimizer.state)))
        optimizer.state = (int(step), *rest)
    elif hasattr(optimizer, "square"):
        optimizer.square = arrays["square"]


def grid_search(settings: dict[str, Sequence], run: Callable[..., float]) -> list[tuple[dict, float]]:
    """``run`` for every combination of settings, best (least) results first."""
    combinations: list[dict] = [{}]
    for name, options in settings.items():
        combinations = [{**c, name: o} for c in combinations for o in options]
    return sorted(((c, run(**c)) for c in combinations), key=lambda pair: pair[1])
