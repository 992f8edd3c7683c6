"""Small models trained by aggregates: each step is one pass over the rows; parameters stay on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.plans import tensor as T
from tensorloom.plans.expr import Expr

# -- losses and scores as Columns --------------------------------------------------------------------------------------


def mse(pred: Column, target: Column) -> Column:
    return F.avg(F.pow(pred - target, F.lit(2.0)))


def binary_cross_entropy(pred: Column, target: Column) -> Column:
    return F.avg(-target * F.log(pred) - (1 - target) * F.log(1 - pred))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, not once for each element that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(values: Column) -> Column:
    """Of an array column, shifted by its largest element."""
    shares = lambda xs: _let(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(xs, lambda x: x / total))
    return _let(F.array_max(values), lambda top: _let(F.transform(values, lambda x: F.exp(x - top)), shares))


def _log_total(values: Column) -> Column:
    """Logarithm of the sum of the elements' exponentials."""
    return _let(F.array_max(values), lambda top: top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def log_softmax(values: Column) -> Column:
    return _let(_log_total(values), lambda total: F.transform(values, lambda x: x - total))


def softmax_cross_entropy(values: Column, label: Column) -> Column:
    """Mean of minus the log-softmax at the label (0-based)."""
    return F.avg(_log_total(values) - F.get(values, label))


def l1(weights: np.ndarray) -> float:
    return float(np.abs(weights).sum())


def l2(weights: np.ndarray) -> float:
    return float((weights**2).sum())


def quality(df: DataFrame, pred: str, target: str, by: list[str] | None = None) -> DataFrame:
    """sse, mse, rmse and accuracy (of rounded predictions), over all rows or per group."""
    square = F.pow(F.col(pred) - F.col(target), F.lit(2.0))
    return df.groupBy(*(by or [])).agg(F.sum(square).alias("sse"), F.avg(square).alias("mse"), F.sqrt(F.avg(square)).alias("rmse"), F.avg((F.rint(pred) == F.col(target)).cast("double")).alias("accuracy"))


def linear_regression(df: DataFrame, inputs: list[str], target: str) -> dict[str, float]:
    """Least squares by the normal equations, from one aggregate of products; ``bias`` is the constant."""
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in inputs)]
    n = len(columns)
    grams = [F.sum(columns[i] * columns[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    row = df.agg(*grams, *(F.sum(c * F.col(target)).alias(f"b{i}") for i, c in enumerate(columns))).first()
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    weights = np.linalg.lstsq(gram, np.array([row[f"b{i}"] for i in range(n)]), rcond=None)[0]
    return dict(zip(["bias", *inputs], map(float, weights), strict=True))


def lq(weights: np.ndarray, q: float) -> float:
    return float((np.abs(weights) ** q).sum())


def derivative_deviation(e: Expr, at: dict[str, float], step: float = 1e-5) -> dict[str, float]:
    """By variable, how far the derivative of ``e`` is from its central difference at a point."""
    exact = e.gradient(sorted(at))
    return {n: abs(exact[n].value(at) - (e.value(at | {n: at[n] + step}) - e.value(at | {n: at[n] - step})) / (2 * step)) for n in at}


# -- optimisers --------------------------------------------------------------------------------------------------------
@dataclass
class GradientDescent:
    rate: float = 1e-4

    def step(self, x: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        return x - self.rate * gradient

    def reset(self) -> None:
        pass


@dataclass
class Adam:
    rate: float = 2e-4
    decay1: float = 0.1
    decay2: float = 1e-3
    offset: float = 1e-8
    state: tuple = (0, 0.0, 0.0)

    def step(self, x, gradient):
        t, m, v = self.state
        t, m, v = t + 1, (1 - self.decay1) * m + self.decay1 * gradient, (1 - self.decay2) * v + self.decay2 * gradient**2
        self.state = (t, m, v)
        return x - self.rate * m / (1 - (1 - self.decay1) ** t) / (np.sqrt(v / (1 - (1 - self.decay2) ** t)) + self.offset)

    def reset(self) -> None:
        self.state = (0, 0.0, 0.0)


@dataclass
class RMSprop:
    rate: float = 2e-4
    offset: float = 1e-8
    square: float | np.ndarray = 0.0

    def step(self, x, gradient):
        self.square = 0.9 * self.square + 0.1 * gradient**2
        return x - self.rate * gradient / (np.sqrt(self.square) + self.offset)

    def reset(self) -> None:
        self.square = 0.0


@dataclass
class Training:
    parameters: dict[str, float]
    log: list[tuple[int, float, float]] = field(default_factory=list)
    reason: str = ""


def train(train_rows: DataFrame, validation_rows: DataFrame, loss: Expr, parameters: dict[str, float], optimizer, *, rates: tuple[float, ...] = (), max_iterations: int = 100, patience: int = 20, target: float | None = None) -> Training:
    """Minimise the mean of ``loss`` over rows; gradients by name come from the expression, one aggregate per step.

    Stops when the validation loss hasn't improved for ``patience`` iterations, reaches ``target`` or isn't finite; for
    each further rate the best parameters are restored and the optimiser starts anew.
    """
    names = sorted(parameters)
    gradient = loss.gradient(names)
    x = np.array([parameters[n] for n in names])
    best, best_loss, log, reason, at = x, np.inf, [], "", 0
    for rate in rates or (optimizer.rate,):
        optimizer.rate = rate
        optimizer.reset()
        x, since = best, 0
        for _ in range(max_iterations):
            bind = dict(zip(names, map(float, x), strict=True))
            row = train_rows.agg(F.avg(loss.column(bind)).alias("loss"), *(F.avg(gradient[n].column(bind)).alias(f"g_{n}") for n in names)).first()
            held = validation_rows.agg(F.avg(loss.column(bind))).first()[0]
            log.append((at, row["loss"], held))
            at += 1
            if not np.isfinite(held):
                reason = "not finite"
                break
            best, best_loss, since = (x, held, 0) if held < best_loss else (best, best_loss, since + 1)
            if target is not None and held <= target:
                reason = "target reached"
                break
            if since >= patience:
                reason = "no improvement"
                break
            x = optimizer.step(x, np.array([row[f"g_{n}"] for n in names]))
        else:
            reason = "iterations used up"
    return Training(dict(zip(names, map(float, best), strict=True)), log, reason)


def cross_entropy(pred: Column, target: Column) -> Column:
    """Mean over rows of minus the sum of target * log(prediction), for array columns."""
    return F.avg(-F.aggregate(F.zip_with(target, pred, lambda t, p: t * F.log(p)), F.lit(0.0), lambda a, x: a + x))


def normalized(df: DataFrame, column: str, out: str) -> DataFrame:
    """A column less its mean, over its population deviation unless that is zero; mean and deviation from one aggregate."""
    mean, deviation = df.agg(F.avg(column), F.stddev_pop(column)).first()
    shifted = F.col(column) - F.lit(mean)
    return df.withColumn(out, shifted / F.lit(deviation) if deviation else shifted)


# -- Gaussian process --------------------------------------------------------------------------------------------------
def squared_exponential(length: float, variance: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda a, b: variance * np.exp(-((a[:, None] - b[None, :]) ** 2) / (2 * length**2))


def linear_kernel() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda a, b: a[:, None] * b[None, :]


def gp_prior(x: np.ndarray, kernel, mean: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a Gaussian process at some points, before anything is known; see ``multivariate_normal`` for draws."""
    return np.full(len(x), float(mean)), kernel(np.asarray(x, float), np.asarray(x, float))


def gp_expressions(n_known: int, n_at: int, length: float, variance: float, noise: float = 0.0) -> tuple[T.Tensor, T.Tensor]:
    """Posterior mean and covariance as expressions of ``known_x``, ``known_y`` and ``at``, with the squared exponential;
    they can be differentiated by all three."""
    known, y, at = T.var("known_x", (n_known,)), T.var("known_y", (n_known,)), T.var("at", (n_at,))

    def kernel(a: T.Tensor, b: T.Tensor) -> T.Tensor:
        d = T.insert_axis(a, 1) - T.insert_axis(b, 0)
        return variance * T.unary("exp", -(d * d) / (2 * length**2))

    inverse = T.invert(kernel(known, known) + noise * T.identity(n_known))
    cross = kernel(at, known)
    return T.dot(cross, T.dot(inverse, y)), kernel(at, at) - cross @ inverse @ cross.T


def gp_predict(df: DataFrame, x: str, known_x: np.ndarray, known_y: np.ndarray, kernel, noise: float = 0.0) -> DataFrame:
    """Posterior mean and variance at each row's ``x`` given a small training set (solved once, then applied per row)."""
    if len(known_x) > 5000:
        raise ValueError("the training set of a Gaussian process must fit in one solve")
    inverse = np.linalg.pinv(kernel(known_x, known_x) + noise * np.eye(len(known_x)))
    weights = inverse @ known_y

    def run(batches):
        for table in batches:
            at = table[x].to_numpy(float)
            cross = kernel(at, known_x)
            prior = np.array([kernel(at[k : k + 1], at[k : k + 1])[0, 0] for k in range(len(at))])
            yield table.assign(gp_mean=cross @ weights, gp_variance=prior - np.einsum("ij,jk,ik->i", cross, inverse, cross))

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "gp_mean double", "gp_variance double"]))


def gp_predict_slopes(df: DataFrame, x: str, known: tuple[np.ndarray, np.ndarray], slopes: tuple[np.ndarray, np.ndarray], length: float, variance: float, noise: float = 0.0, slope_noise: float = 0.0) -> DataFrame:
    """As ``gp_predict`` with the squared exponential, from known values and known slopes; also the slope's mean and variance."""
    (known_x, known_y), (slope_x, slope_y) = known, slopes
    n = len(known_x)
    if n + len(slope_x) > 5000:
        raise ValueError("the training set of a Gaussian process must fit in one solve")
    kernel = squared_exponential(length, variance)
    first = lambda a, b: -(a[:, None] - b[None, :]) / length**2 * kernel(a, b)  # noqa: E731  # by a
    second = lambda a, b: (1 / length**2 - (a[:, None] - b[None, :]) ** 2 / length**4) * kernel(a, b)  # noqa: E731  # by a and b
    cross = first(slope_x, known_x)
    inverse = np.linalg.pinv(np.block([[kernel(known_x, known_x) + noise * np.eye(n), cross.T], [cross, second(slope_x, slope_x) + slope_noise * np.eye(len(slope_x))]]))
    weights = inverse @ np.concatenate([known_y, slope_y])

    def run(batches):
        for table in batches:
            at = table[x].to_numpy(float)
            out = {}
            for name, rows, prior in (("gp", np.hstack([kernel(at, known_x), first(slope_x, at).T]), variance), ("gp_slope", np.hstack([first(at, known_x), second(at, slope_x)]), variance / length**2)):
                out[f"{name}_mean"], out[f"{name}_variance"] = rows @ weights, prior - np.einsum("ij,jk,ik->i", rows, inverse, rows)
            yield table.assign(**out)

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} double" for n in ("gp_mean", "gp_variance", "gp_slope_mean", "gp_slope_variance"))]))
