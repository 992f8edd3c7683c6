"""Scalar operators as Columns with IEEE results: no ANSI errors, no NULL where a number is due, NaN unequal to all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: What arg and find reductions give where nothing is found (a fixed value: the least int64 plus 4).
NOT_FOUND = -9223372036854775804


def _log(c: Column, base: Callable[[Column], Column]) -> Column:
    d = c.cast("double")
    return F.when(F.isnan(d) | (d < 0), F.lit(NAN)).when(d == 0, F.lit(-INF)).otherwise(base(d))


def _whole(c: Column, to: Callable[[Column], Column]) -> Column:
    """Rounding to whole numbers that keeps doubles: beyond 2**53 they are whole already."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) >= 2.0**53), d).otherwise(to(d).cast("double"))


UNARY: dict[str, Callable[[Column], Column]] = {
    "plus": lambda c: c,
    "negate": lambda c: -c,
    "abs": F.abs,
    "sgn": lambda c: F.when(F.isnan(c.cast("double")), F.lit(0.0)).otherwise(F.signum(c.cast("double"))),
    "log": lambda c: _log(c, F.log),
    "log10": lambda c: _log(c, F.log10),
    "exp": F.exp,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "sqrt": F.sqrt,
    "ceil": lambda c: _whole(c, F.ceil),
    "floor": lambda c: _whole(c, F.floor),
    "round": F.rint,  # half to even
    "truncate": lambda c: F.when(c < 0, _whole(c, F.ceil)).otherwise(_whole(c, F.floor)),
    "is_finite": lambda c: ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < INF),
    "not": lambda c: ~c,
}


def _no_nan(a: Column, b: Column) -> Column:
    return ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def divide(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).otherwise(F.signum(x) * F.when(y.cast("string") == "-0.0", -INF).otherwise(INF))
    return F.when(y == 0, at_zero).otherwise(x / F.when(y != 0, y))


def modulo(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    return F.when(y == 0, F.lit(NAN)).otherwise(x % F.when(y != 0, y))


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": divide,
    "modulo": modulo,
    "power": lambda a, b: F.pow(a, b),
    "max_elemwise": lambda a, b: F.when(_no_nan(a, b) & (a > b), a).otherwise(b),
    "min_elemwise": lambda a, b: F.when(_no_nan(a, b) & (a < b), a).otherwise(b),
    "equal": lambda a, b: _no_nan(a, b) & (a == b),
    "not_equal": lambda a, b: ~(_no_nan(a, b) & (a == b)),
    "less": lambda a, b: _no_nan(a, b) & (a < b),
    "less_or_equal": lambda a, b: _no_nan(a, b) & (a <= b),
    "greater": lambda a, b: _no_nan(a, b) & (a > b),
    "greater_or_equal": lambda a, b: _no_nan(a, b) & (a >= b),
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "xor": lambda a, b: a != b,
}


def is_close(a: Column, b: Column, abs_tol: float = 1e-8, rel_tol: float = 1e-5) -> Column:
    """|a - b| <= abs_tol + rel_tol * |b| with IEEE infinities: equal infinities differ by NaN, so they aren't close, and all
    finite numbers are close to an infinite ``b``.  Integers are compared exactly: see ``binary``."""
    off = F.abs(a.cast("double") - b.cast("double"))
    return _no_nan(a, b) & ~F.isnan(off) & (off <= abs_tol + rel_tol * F.abs(b.cast("double")))


# -- integers --------------------------------------------------------------------------------------------------------
#: Bits of the integer types.
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_LOW32 = 0xFFFFFFFF


def limits(kind: str) -> tuple:
    """The least and the largest finite value of a type."""
    if kind in BITS:
        return -(1 << (BITS[kind] - 1)), (1 << (BITS[kind] - 1)) - 1
    top = 3.4028234663852886e38 if kind == "float" else 1.7976931348623157e308
    return -top, top


def wrapped(c: Column, kind: str) -> Column:
    """A long reduced to an integer type by dropping high bits, where a cast would be an error."""
    spare = 64 - BITS[kind]
    return c if not spare else F.shiftright(F.shiftleft(c, spare), spare).cast(kind)


def _add64(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(_LOW32)) + b.bitwiseAND(F.lit(_LOW32))
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW32)))


def _subtract64(a: Column, b: Column) -> Column:
    return _add64(_add64(a, F.bitwise_not(b)), F.lit(1).cast("long"))


def _multiply64(a: Column, b: Column) -> Column:
    low = lambda c: c.bitwiseAND(F.lit(_LOW32))
    ah, al, bh, bl = F.shiftright(a, 32), low(a), F.shiftright(b, 32), low(b)
    # All but the last 16 bits, in sums below 2**51, and those 16.
    least = al.bitwiseAND(F.lit(0xFFFF)) * bl
    rest = F.shiftleft(low(ah * bl) + low(al * bh), 16) + F.shiftright(al, 16) * bl + F.shiftright(least, 16)
    return F.shiftleft(rest, 16).bitwiseOR(least.bitwiseAND(F.lit(0xFFFF)))


def sum_parts(c: Column) -> list[Column]:
    """Aggregates of 16-bit parts of an integer column, which can't overflow; ``sum_of_parts`` puts them together."""
    v = c.cast("long")
    parts = [F.shiftright(v, 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(3)] + [F.shiftright(v, 48)]
    return [F.coalesce(F.sum(p), F.lit(0)) for p in parts]


def sum_of_parts(parts: list[Column], kind: str) -> Column:
    total = parts[0]
    for k in (1, 2, 3):
        total = _add64(total, F.shiftleft(parts[k], 16 * k))
    return wrapped(total, kind)


_WRAPPING = {"add": _add64, "subtract": _subtract64, "multiply": _multiply64}


def binary(name: str, a: Column, b: Column, kind: str) -> Column:
    """``BINARY[name]`` for operands of one type: integers wrap around, divide towards zero and are compared exactly;
    an integer divided by zero is an error."""
    if name == "is_close":
        return a == b if kind in BITS or kind == "boolean" else is_close(a, b)
    if kind not in BITS:
        return BINARY[name](a, b)
    if name in _WRAPPING:
        return wrapped(_WRAPPING[name](a.cast("long"), b.cast("long")), kind)
    if name == "divide":
        return F.call_function("div", a, b).cast(kind)
    if name == "modulo":
        return (a % b).cast(kind)
    plain = {"equal": a == b, "not_equal": a != b, "less": a < b, "less_or_equal": a <= b, "greater": a > b, "greater_or_equal": a >= b, "max_elemwise": F.greatest(a, b), "min_elemwise": F.least(a, b)}
    return plain[name] if name in plain else BINARY[name](a, b)


def unary(name: str, c: Column, kind: str) -> Column:
    """``UNARY[name]`` by type: a negated integer wraps around, its sign keeps its type; the absolute value of the least is an error."""
    if kind in BITS and name == "negate":
        return wrapped(_subtract64(F.lit(0).cast("long"), c.cast("long")), kind)
    if kind in BITS and name == "sgn":
        return F.signum(c).cast(kind)
    if kind in BITS and name in ("ceil", "floor", "round", "truncate"):
        return c
    return F.lit(True) if name == "is_finite" and kind in (*BITS, "boolean") else UNARY[name](c)


def convert(c: Column, source: str, target: str) -> Column:
    """A number as another type: integers lose high bits; reals are cut towards zero, and NaN and what is out of the
    type's range become its least value."""
    if target not in BITS or source == "boolean":
        return c.cast(target)
    if source in BITS:
        return wrapped(c.cast("long"), target)
    if BITS[target] < 32:
        return wrapped(convert(c, source, "int").cast("long"), target)
    least, most = limits(target)
    fits = ~F.isnan(c) & (c.cast("double") > float(least) - (1 if target == "int" else 0)) & (c.cast("double") < float(most + 1))
    return F.when(fits, F.when(fits, c).cast(target)).otherwise(F.lit(least).cast(target))


def cage(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp; a missing bound is open."""
    out = c if low is None else BINARY["max_elemwise"](F.lit(low), c)
    return out if high is None else BINARY["min_elemwise"](F.lit(high), out)


def sigmoid(c: Column) -> Column:
    return (F.tanh(c / 2) + 1) / 2


def relu(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(F.lit(0.0))


def normal_pdf(x: Column, mean: Column | float = 0.0, variance: Column | float = 1.0) -> Column:
    mean, variance = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, variance))
    return F.exp(-F.pow(x - mean, F.lit(2.0)) / (2 * variance)) / F.sqrt(2 * F.pi() * variance)


#: Coefficients of the polynomial in t = 1 / (1 + |x| / 2) that approximates erf to 1.2e-7, from t^0 to t^9.
_ERF = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erf(x: Column) -> Column:
    t = F.lit(1.0) / (F.abs(x) / 2 + 1)
    power = F.lit(_ERF[-1])
    for c in reversed(_ERF[:-1]):
        power = power * t + c
    tail = t * F.exp(power - x * x)
    return F.when(x >= 0, 1 - tail).otherwise(tail - 1)


def normal_cdf(x: Column, mean: Column | float = 0.0, variance: Column | float = 1.0) -> Column:
    mean, variance = (v if isinstance(v, Column) else F.lit(float(v)) for v in (mean, variance))
    return (erf((x - mean) / F.sqrt(2 * variance)) + 1) / 2
