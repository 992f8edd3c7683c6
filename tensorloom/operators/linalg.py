"""Linear algebra.  What is long is reduced by distributed aggregates; only small square blocks are handed to numpy.

Batches of matrices are independent groups (``applyInPandas``); whitening needs one Gram aggregate over all rows, of a
size set by the number of features, which is checked against ``MAX_FEATURES`` before it comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.frame import TensorFrame, _i

MAX_FEATURES = 4096


class SingularMatrixError(ValueError):
    pass


def _batched(t: TensorFrame, fn: Callable[[np.ndarray], np.ndarray], out_rank: int, out_shape: tuple[int, ...]) -> TensorFrame:
    """``fn`` on each matrix of the last two axes."""
    m, n = t.shape[-2:]
    if m * n > MAX_FEATURES**2:
        raise ValueError(f"a {m} x {n} matrix is too large for one task")
    lead = _i(t.n_dims - 2)
    row, column = f"i{t.n_dims - 2}", f"i{t.n_dims - 1}"

    def solve(key, table: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((m, n))
        a[table[row], table[column]] = table["v"]
        out = np.asarray(fn(a), float)
        index = np.indices(out.shape).reshape(out_rank, -1)
        made = {c: np.full(out.size, key[k], np.int64) for k, c in enumerate(lead)}
        made |= {f"i{len(lead) + k}": index[k].astype(np.int64) for k in range(out_rank)}
        return pd.DataFrame(made | {"v": out.reshape(-1)})

    schema = ", ".join([*(f"i{k} long" for k in range(len(lead) + out_rank)), "v double"])
    grouped = t.df.groupBy(*lead) if lead else t.df.withColumn("_all", F.lit(0)).groupBy("_all")
    return TensorFrame(grouped.applyInPandas(solve, schema), [*t.shape[:-2], *out_shape])


def invert(t: TensorFrame) -> TensorFrame:
    def one(a: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.inv(a)
        except np.linalg.LinAlgError as e:
            raise SingularMatrixError("a singular matrix has no inverse") from e

    return _batched(t, one, 2, t.shape[-2:])


def _split(t: TensorFrame, fn: Callable[[np.ndarray], Sequence[np.ndarray]], shapes: Sequence[tuple[int, ...]]) -> list[TensorFrame]:
    """As ``_batched`` for functions with several results: each matrix is gone through once, and the results are kept."""
    m, n = t.shape[-2:]
    if m * n > MAX_FEATURES**2:
        raise ValueError(f"a {m} x {n} matrix is too large for one task")
    lead = _i(t.n_dims - 2)
    row, column = f"i{t.n_dims - 2}", f"i{t.n_dims - 1}"

    def solve(key, table: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((m, n))
        a[table[row], table[column]] = table["v"]
        made = {c: [key[k]] for k, c in enumerate(lead)}
        return pd.DataFrame(made | {f"p{k}": [np.asarray(x, float).reshape(-1)] for k, x in enumerate(fn(a))})

    schema = ", ".join([*(f"{c} long" for c in lead), *(f"p{k} array<double>" for k in range(len(shapes)))])
    grouped = t.df.groupBy(*lead) if lead else t.df.withColumn("_all", F.lit(0)).groupBy("_all")
    found, out = grouped.applyInPandas(solve, schema).persist(), []
    for k, shape in enumerate(shapes):
        flat = found.select(*lead, F.posexplode(f"p{k}").alias("_at", "v")).withColumn("_at", F.col("_at").cast("long"))
        whole = TensorFrame(flat.withColumnRenamed("_at", f"i{len(lead)}"), [*t.shape[:-2], math.prod(shape)])
        out.append(whole.reshape([*t.shape[:-2], *shape]))
    return out


def svd(t: TensorFrame) -> tuple[TensorFrame, TensorFrame, TensorFrame]:
    """Full U, singular values and V (not transposed), from one decomposition."""
    m, n = t.shape[-2:]

    def one(a: np.ndarray):
        u, s, vt = np.linalg.svd(a)
        return u, s, vt.T

    u, s, v = _split(t, one, [(m, m), (min(m, n),), (n, n)])
    return u, s, v


def pseudo_invert(t: TensorFrame, r_cond: float = 1e-15) -> TensorFrame:
    """Moore-Penrose inverse; singular values below the absolute ``r_cond`` count as zero."""

    def one(a: np.ndarray) -> np.ndarray:
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        return (vt.T * np.where(s >= r_cond, 1 / np.where(s >= r_cond, s, 1), 0.0)) @ u.T

    return _batched(t, one, 2, t.shape[-2:][::-1])


def symmetric_eigen(t: TensorFrame, part: str = "L") -> tuple[TensorFrame, TensorFrame]:
    """Eigenvalues ascending, and eigenvectors in columns."""
    n = t.shape[-1]
    values, vectors = _split(t, lambda a: np.linalg.eigh(a, part), [(n,), (n, n)])
    return values, vectors


# -- whitening ---------------------------------------------------------------------------------------------------------
@dataclass
class Whitening:
    """PCA whitening of rows with an array column; ``zca``: rotated back to the features' axes."""

    mean: np.ndarray
    variances: np.ndarray
    axes: np.ndarray
    zca: bool = False

    @classmethod
    def fit(cls, df: DataFrame, column: str, n_comps: int | None = None, zca: bool = False) -> Whitening:
        """Mean and covariance (divided by n) from one pass of blocked partial sums about a pilot row.

        Sums about a row of the data keep the digits that sums about zero lose where means are large beside deviations.
        """
        first = df.select(F.col(column).alias("a")).where("a IS NOT NULL").first()
        if first is None:
            raise ValueError("there are no rows to learn from")
        pilot = np.asarray(first["a"], float)
        width = len(pilot)
        if width > MAX_FEATURES:
            raise ValueError(f"{width} features are too many for a covariance matrix")

        def moments(batches):
            n, total, square = 0, np.zeros(width), np.zeros((width, width))
            for table in batches:
                if not len(table):
                    continue
                x = np.stack(table[column].to_numpy()).astype(float) - pilot
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
            yield pd.DataFrame({"sums": [np.concatenate([[n], total, square.reshape(-1)])]})

        parts = df.where(F.col(column).isNotNull()).select(column).mapInPandas(moments, "sums array<double>")
        found = parts.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).toPandas().sort_values("k")["x"].to_numpy()
        n, shift, square = found[0], found[1 : width + 1] / found[0], found[width + 1 :].reshape(width, width) / found[0]
        mean = pilot + shift
        values, vectors = np.linalg.eigh(square - np.outer(shift, shift))
        order = np.argsort(values)[::-1][: n_comps or width]
        return cls(mean, values[order], vectors[:, order], zca)

    def _apply(self, df: DataFrame, column: str, matrix: np.ndarray, before: np.ndarray, after: np.ndarray) -> DataFrame:
        def run(batches):
            for table in batches:
                x = (np.stack(table[column].to_numpy()).astype(float) - before) @ matrix + after if len(table) else np.zeros((0, 1))
                yield table.assign(**{column: list(x)})

        fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(run, fields)

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        matrix = self.axes / np.sqrt(self.variances)
        return self._apply(df, column, matrix @ self.axes.T if self.zca else matrix, self.mean, 0.0)

    def inverse(self, df: DataFrame, column: str) -> DataFrame:
        matrix = (self.axes * np.sqrt(self.variances)).T
        return self._apply(df, column, self.axes @ matrix if self.zca else matrix, 0.0, self.mean)


# -- exact algebra on small matrices -----------------------------------------------------------------------------------
Matrix = list[list[Fraction]]


def bezout(a: int, b: int) -> tuple[int, int, int]:
    """(x, y, g) with x*a + y*b = g = gcd(a, b) >= 0."""
    x, y, u, v = 1, 0, 0, 1
    while b:
        q, r = divmod(a, b)
        a, b, x, y, u, v = b, r, u, v, x - q * u, y - q * v
    return (x, y, a) if a >= 0 else (-x, -y, -a)


def row_echelon(m, right=None) -> tuple[Matrix, Matrix | None]:
    """Reduced row echelon form with pivots of largest magnitude, exactly; ``right`` is transformed along."""
    a = [[Fraction(x) for x in row] for row in m]
    b = [[Fraction(x) for x in row] for row in right] if right is not None else [[] for _ in a]
    top = 0
    for col in range(len(a[0]) if a else 0):
        best = max(range(top, len(a)), key=lambda r: abs(a[r][col]), default=None)
        if best is None or not a[best][col]:
            continue
        a[top], a[best], b[top], b[best] = a[best], a[top], b[best], b[top]
        pivot = a[top][col]
        a[top], b[top] = [x / pivot for x in a[top]], [x / pivot for x in b[top]]
        for r in range(len(a)):
            if r != top and a[r][col]:
                f = a[r][col]
                a[r] = [x - f * y for x, y in zip(a[r], a[top], strict=True)]
                b[r] = [x - f * y for x, y in zip(b[r], b[top], strict=True)]
        top += 1
    return a, b if right is not None else None


def _times(a, b):
    return [[sum((x * y for x, y in zip(row, col, strict=True)), Fraction(0)) for col in zip(*b, strict=True)] for row in a]


def general_inverse(m) -> tuple[Matrix, Matrix, Matrix]:
    """(I, S, N): M I M = M; the rows of S span what M's left side misses (S M = 0), the columns of N its null space (M N = 0)."""
    rows, cols = len(m), len(m[0])
    eye = [[Fraction(i == j) for j in range(rows)] for i in range(rows)]
    echelon, left = row_echelon(m, eye)
    pivots = [next(j for j, x in enumerate(row) if x) for row in echelon if any(row)]
    inverse = [[Fraction(0)] * rows for _ in range(cols)]
    for r, j in enumerate(pivots):
        inverse[j] = left[r]
    null = []
    for j in (j for j in range(cols) if j not in pivots):
        v = [Fraction(0)] * cols
        v[j] = Fraction(1)
        for r, p in enumerate(pivots):
            v[p] = -echelon[r][j]
        null.append(v)
    return inverse, left[len(pivots) :], [list(x) for x in zip(*null, strict=True)] if null else [[] for _ in range(cols)]


def smith_normal_form(m) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
    """(U, S, V), unimodular U and V with U M V = S diagonal, each entry dividing the next."""
    s = [[int(x) for x in row] for row in m]
    rows, cols = len(s), len(s[0])
    u = [[int(i == j) for j in range(rows)] for i in range(rows)]
    v = [[int(i == j) for j in range(cols)] for i in range(cols)]

    def add_row(to, source, f):
        for x in (s, u):
            x[to] = [a + f * b for a, b in zip(x[to], x[source], strict=True)]

    def add_col(to, source, f):
        for x in (s, v):
            for row in x:
                row[to] += f * row[source]

    for t in range(min(rows, cols)):
        while True:
            spots = [(abs(s[i][j]), i, j) for i in range(t, rows) for j in range(t, cols) if s[i][j]]
            if not spots:
                return u, s, v
            _, i, j = min(spots)
            for x in (s, u):
                x[t], x[i] = x[i], x[t]
            for x in (s, v):
                for row in x:
                    row[t], row[j] = row[j], row[t]
            for r in range(t + 1, rows):
                add_row(r, t, -(s[r][t] // s[t][t]))
            for c in range(t + 1, cols):
                add_col(c, t, -(s[t][c] // s[t][t]))
            if any(s[r][t] for r in range(t + 1, rows)) or any(s[t][c] for c in range(t + 1, cols)):
                continue
            rest = next((r for r in range(t + 1, rows) for c in range(t + 1, cols) if s[r][c] % s[t][t]), None)
            if rest is None:
                break
            add_row(t, rest, 1)
        if s[t][t] < 0:
            add_row(t, t, -2)
    return u, s, v


def integer_inverse(m) -> Matrix:
    """A rational I with M I M = M, by way of the Smith form."""
    u, s, v = smith_normal_form(m)
    flipped = [[Fraction(1, s[j][i]) if i == j and s[j][i] else Fraction(0) for j in range(len(s))] for i in range(len(s[0]))]
    return _times(_times(v, flipped), u)
