"""Exact fractions as Columns of struct<num: bigint, den: bigint>, in lowest terms with den >= 0.

den = 0 stands for what isn't finite: (1, 0) and (-1, 0) are the infinities, (0, 0) is NaN.  Products of two 64-bit
numbers are held in 38 decimal digits and reduced before they become 64-bit again; what doesn't fit then is an error, it
never wraps around (under ANSI mode, Spark's default).  A null operand gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIONAL = "struct<num:bigint,den:bigint>"
_WIDE = "decimal(38,0)"
#: Euclid's algorithm takes at most this many steps for numbers of 38 digits (Lame's bound: five a digit).
_STEPS = 5 * 38


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _wide(c: Column) -> Column:
    return c.cast(_WIDE)


def _pair(num: Column, den: Column) -> Column:
    return F.struct(num.alias("num"), den.alias("den"))


def _gcd(a: Column, b: Column) -> Column:
    """Of wide numbers that aren't negative."""
    step = lambda s, _: F.when(s["den"] == 0, s).otherwise(_pair(s["den"], _wide(s["num"] % s["den"])))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), _pair(a, b), step)["num"]


def _quotient(n: Column, g: Column) -> Column:
    """n / g, which is whole, as a bigint; ``div`` wraps around, which the product tells."""
    return _let(F.call_function("div", n, g), lambda q: F.when(_wide(q) * g == n, q).otherwise(F.raise_error(F.lit("a fraction needs more than 64 bits")).cast("bigint")))


def rational(num: Column, den: Column | int = 1) -> Column:
    """num / den in lowest terms; of x / 0 only the sign stays."""
    den = den if isinstance(den, Column) else F.lit(den)

    def reduced(p: Column) -> Column:
        n, d = p["num"], p["den"]
        over = lambda g: _pair(_quotient(F.when(d < 0, -n).otherwise(n), g), _quotient(F.abs(d), g))
        sign = F.when(n > 0, 1).when(n < 0, -1).otherwise(0).cast("bigint")
        return F.when(d == 0, _pair(sign, F.lit(0).cast("bigint"))).otherwise(_let(_gcd(F.abs(n), F.abs(d)), over))

    made = _let(_pair(_wide(num), _wide(den)), reduced)
    return F.when(num.isNotNull() & den.isNotNull(), made)


def _both(a: Column, b: Column, body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``body`` of the wide parts of two fractions; null if one is null."""
    held = F.struct(a.alias("a"), b.alias("b"))
    return _let(held, lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), body(*(_wide(p[x][y]) for x in "ab" for y in ("num", "den")))))


def _one(a: Column, body: Callable[[Column, Column], Column]) -> Column:
    return _let(a, lambda p: F.when(p.isNotNull(), body(p["num"], p["den"])))


def add(a: Column, b: Column) -> Column:
    """NaN for infinities of opposite sign."""

    def sums(an, ad, bn, bd):
        nan = ((ad == 0) & (an == 0)) | ((bd == 0) & (bn == 0)) | ((ad == 0) & (bd == 0) & (an != bn))
        infinite = F.when(nan, rational(F.lit(0), 0)).when(ad == 0, rational(an, 0)).otherwise(rational(bn, 0))
        return F.when((ad == 0) | (bd == 0), infinite).otherwise(rational(an * bd + bn * ad, ad * bd))

    return _both(a, b, sums)


def subtract(a: Column, b: Column) -> Column:
    return add(a, negate(b))


def multiply(a: Column, b: Column) -> Column:
    return _both(a, b, lambda an, ad, bn, bd: rational(an * bn, ad * bd))


def divide(a: Column, b: Column) -> Column:
    """x / 0 is infinite, 0 / 0 NaN; an infinity keeps its sign whatever it is divided by."""
    return _both(a, b, lambda an, ad, bn, bd: rational(an * bd, ad * bn))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of ``a``; by zero or of an infinity it is an error."""
    return _both(a, b, lambda an, ad, bn, bd: rational((an * bd) % (bn * ad), ad * bd))


def negate(a: Column) -> Column:
    return _one(a, lambda n, d: _pair(-n, d))


def absolute(a: Column) -> Column:
    return _one(a, lambda n, d: _pair(F.abs(n), d))


def sign(a: Column) -> Column:
    """-1, 0 or 1; 0 for NaN."""
    return _one(a, lambda n, d: F.when(n > 0, 1).when(n < 0, -1).otherwise(0))


def _rounded(a: Column, toward: Callable[[Column, Column], Column]) -> Column:
    """Whole numbers; what isn't finite stays."""
    return _one(a, lambda n, d: F.when(d == 0, _pair(n, d)).otherwise(_pair(F.call_function("div", n, d) + toward(n, d), F.lit(1).cast("bigint"))))


def truncate(a: Column) -> Column:
    return _rounded(a, lambda n, d: F.lit(0).cast("bigint"))


def floor(a: Column) -> Column:
    return _rounded(a, lambda n, d: F.when((n < 0) & (n % d != 0), -1).otherwise(0).cast("bigint"))


def ceil(a: Column) -> Column:
    return _rounded(a, lambda n, d: F.when((n > 0) & (n % d != 0), 1).otherwise(0).cast("bigint"))


def is_int(a: Column) -> Column:
    return a["den"] == 1


def is_finite(a: Column) -> Column:
    return a["den"] != 0


def is_nan(a: Column) -> Column:
    return (a["den"] == 0) & (a["num"] == 0)


def is_inf(a: Column) -> Column:
    return (a["den"] == 0) & (a["num"] != 0)


def equal(a: Column, b: Column) -> Column:
    """NaN equals nothing."""
    return _both(a, b, lambda an, ad, bn, bd: (an == bn) & (ad == bd) & ~((ad == 0) & (an == 0)))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in the order NaN, -infinity, numbers, infinity; two NaN share a place."""

    def signs(an, ad, bn, bd):
        rank = lambda n, d: F.when(d != 0, 0).when(n > 0, 1).when(n < 0, -1).otherwise(-2)
        order = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
        return F.when((ad != 0) & (bd != 0), order(an * bd, bn * ad)).otherwise(order(rank(an, ad), rank(bn, bd)))

    return _both(a, b, signs)


def to_double(a: Column) -> Column:
    special = lambda n: F.when(n > 0, float("inf")).when(n < 0, float("-inf")).otherwise(float("nan"))
    return _one(a, lambda n, d: F.when(d == 0, special(n)).otherwise(n.cast("double") / d.cast("double")))


def to_long(a: Column) -> Column:
    """The whole number; an error where it isn't one."""
    return _one(a, lambda n, d: F.when(d == 1, n).otherwise(F.raise_error(F.lit("not a whole number")).cast("bigint")))


def pretty(a: Column) -> Column:
    special = lambda n: F.when(n > 0, "Inf").when(n < 0, "-Inf").otherwise("NaN")
    return _one(a, lambda n, d: F.when(d == 0, special(n)).when(d == 1, n.cast("string")).otherwise(F.concat_ws("/", n.cast("string"), d.cast("string"))))
