"""Scalar expressions over named columns, with reverse-mode derivatives that are expressions again.

An expression becomes a Column (``column``) or a number (``value``), so a model's loss and its gradient are evaluated by
one aggregate over all rows, in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.functions.scalar import BINARY, UNARY


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple = ()

    def _with(self, op: str, other) -> Expr:
        return Expr(op, (self, wrap(other)))

    def __add__(self, o):
        return self._with("add", o)

    def __radd__(self, o):
        return wrap(o) + self

    def __sub__(self, o):
        return self._with("subtract", o)

    def __rsub__(self, o):
        return wrap(o) - self

    def __mul__(self, o):
        return self._with("multiply", o)

    def __rmul__(self, o):
        return wrap(o) * self

    def __truediv__(self, o):
        return self._with("divide", o)

    def __rtruediv__(self, o):
        return wrap(o) / self

    def __pow__(self, o):
        return self._with("power", o)

    def __neg__(self):
        return Expr("negate", (self,))

    # -- evaluation ------------------------------------------------------------------------------------------------
    def column(self, bind: Mapping[str, Column | float] = {}) -> Column:
        """A Column; names that ``bind`` doesn't have are columns of the frame."""
        if self.op == "const":
            return F.lit(float(self.args[0]))
        if self.op == "var":
            x = bind.get(self.args[0], F.col(self.args[0]))
            return x if isinstance(x, Column) else F.lit(float(x))
        args = [a.column(bind) for a in self.args]
        if self.op == "where":
            return F.when(args[0] > args[1], args[2]).otherwise(args[3])
        return UNARY[self.op](*args) if len(args) == 1 and self.op in UNARY else args[0] if self.op == "stop" else BINARY[self.op](*args)

    def value(self, bind: Mapping[str, float]) -> float:
        if self.op == "const":
            return self.args[0]
        if self.op == "var":
            return bind[self.args[0]]
        a = [x.value(bind) for x in self.args]
        plain = {"add": lambda: a[0] + a[1], "subtract": lambda: a[0] - a[1], "multiply": lambda: a[0] * a[1], "divide": lambda: a[0] / a[1], "power": lambda: a[0] ** a[1], "negate": lambda: -a[0], "abs": lambda: abs(a[0]), "sgn": lambda: (a[0] > 0) - (a[0] < 0), "stop": lambda: a[0], "where": lambda: a[2] if a[0] > a[1] else a[3], "max_elemwise": lambda: a[0] if a[0] > a[1] else a[1], "min_elemwise": lambda: a[0] if a[0] < a[1] else a[1]}
        return float(plain[self.op]() if self.op in plain else getattr(math, self.op)(a[0]))

    def compiled(self, names: Sequence[str]) -> Callable[..., float]:
        """A Python function of numbers in the order of ``names``, with IEEE results; shared parts are computed once."""
        places = {n: f"x{k}" for k, n in enumerate(names)}
        lines: list[str] = []
        known: dict[Expr, str] = {}

        def code(e: Expr) -> str:
            if e.op == "const":
                return f"({e.args[0]!r})" if math.isfinite(e.args[0]) else f"float('{e.args[0]}')"
            if e.op == "var":
                return places[e.args[0]]
            if e not in known:
                a = [code(x) for x in e.args]
                plain = {"add": "{0} + {1}", "subtract": "{0} - {1}", "multiply": "{0} * {1}", "negate": "-{0}", "plus": "{0}", "stop": "{0}", "abs": "abs({0})", "where": "{2} if {0} > {1} else {3}", "max_elemwise": "{0} if {0} > {1} else {1}", "min_elemwise": "{0} if {0} < {1} else {1}", "sgn": "float(({0} > 0) - ({0} < 0))"}
                lines.append(f"    t{len(known)} = " + (plain[e.op].format(*a) if e.op in plain else f"_{e.op}({', '.join(a)})"))
                known[e] = f"t{len(known)}"
            return known[e]

        result = code(self)
        space = {f"_{n}": f for n, f in _SAFE.items()}
        exec(f"def run({', '.join(places.values())}):\n" + "".join(line + "\n" for line in lines) + f"    return {result}\n", space)
        return space["run"]

    def variables(self) -> set[str]:
        return {self.args[0]} if self.op == "var" else set().union(*(a.variables() for a in self.args if isinstance(a, Expr)))

    # -- derivatives -----------------------------------------------------------------------------------------------
    def gradient(self, names: list[str]) -> dict[str, Expr]:
        """Derivatives with respect to variables, by one sweep from the root; shared parts are visited once."""
        order: list[Expr] = []
        seen: set[Expr] = set()

        def visit(e: Expr) -> None:
            if e not in seen:
                seen.add(e)
                for a in e.args:
                    if isinstance(a, Expr):
                        visit(a)
                order.append(e)

        visit(self)
        flow: dict[Expr, Expr] = {self: const(1)}
        out = {n: const(0) for n in names}
        for e in reversed(order):
            g = flow.get(e)
            if g is None:
                continue
            if e.op == "var" and e.args[0] in out:
                out[e.args[0]] = out[e.args[0]] + g
            for a, d in zip(e.args, _slopes(e), strict=False) if e.op not in ("const", "var") else ():
                if d is not None:
                    flow[a] = (flow[a] + g * d).simple() if a in flow else (g * d).simple()
        return {n: e.simple() for n, e in out.items()}

    # -- tree ------------------------------------------------------------------------------------------------------
    def map_operands(self, fn) -> Expr:
        return Expr(self.op, tuple(fn(a) if isinstance(a, Expr) else a for a in self.args))

    def subst(self, part: Expr, by: Expr) -> Expr:
        return by if self == part else self.map_operands(lambda a: a.subst(part, by))

    def contains(self, part: Expr) -> bool:
        return self == part or any(isinstance(a, Expr) and a.contains(part) for a in self.args)

    def count_ops(self) -> int:
        return 1 + sum(a.count_ops() for a in self.args if isinstance(a, Expr))

    def simple(self) -> Expr:
        """Constants folded, neutral elements dropped."""
        e = self.map_operands(lambda a: a.simple())
        a = e.args
        fixed = [x.args[0] if isinstance(x, Expr) and x.op == "const" else None for x in a]
        if e.op not in ("const", "var", "stop") and a and all(x is not None for x in fixed):
            try:
                return const(e.value({}))
            except (ArithmeticError, ValueError):
                return e
        if e.op == "add" and 0 in fixed:
            return a[1 - fixed.index(0)]
        if e.op == "subtract" and fixed[1] == 0:
            return a[0]
        if e.op == "multiply" and 0 in fixed:
            return const(0)
        if e.op == "multiply" and 1 in fixed:
            return a[1 - fixed.index(1)]
        if e.op in ("divide", "power") and fixed[1] == 1:
            return a[0]
        return a[0].args[0] if e.op == "negate" and a[0].op == "negate" else e


def _ieee(f: Callable[..., float]) -> Callable[..., float]:
    """A function of numpy's, on single numbers: infinities and NaN where Python would raise."""

    def run(*xs: float) -> float:
        with np.errstate(all="ignore"):
            return float(f(*xs))

    return run


def _quick(f: Callable[[float], float], full: Callable[..., float]) -> Callable[[float], float]:
    slow = _ieee(full)

    def run(x: float) -> float:
        try:
            return f(x)
        except (ArithmeticError, ValueError):
            return slow(x)

    return run


#: Operations of compiled expressions that plain Python doesn't have or raises in.
_SAFE: dict[str, Callable[..., float]] = {
    **{n: _quick(getattr(math, n), getattr(np, m)) for n, m in {"log": "log", "log10": "log10", "exp": "exp", "sin": "sin", "cos": "cos", "tan": "tan", "asin": "arcsin", "acos": "arccos", "atan": "arctan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "sqrt": "sqrt"}.items()},
    **{n: _ieee(f) for n, f in {"ceil": np.ceil, "floor": np.floor, "round": np.rint, "truncate": np.trunc, "divide": np.divide, "modulo": np.fmod, "power": np.float_power}.items()},
}


def const(x: float) -> Expr:
    return Expr("const", (float(x),))


def var(name: str) -> Expr:
    return Expr("var", (name,))


def wrap(x) -> Expr:
    return x if isinstance(x, Expr) else const(x)


def unary(name: str, x) -> Expr:
    return Expr(name, (wrap(x),))


def stop_gradient(x) -> Expr:
    """The value of ``x`` with a derivative that counts as zero."""
    return Expr("stop", (wrap(x),))


def where_greater(a, b, yes, no) -> Expr:
    return Expr("where", (wrap(a), wrap(b), wrap(yes), wrap(no)))


def sigmoid(x) -> Expr:
    return (unary("tanh", wrap(x) / 2) + 1) / 2


def _slopes(e: Expr) -> list[Expr | None]:
    """Derivative by each operand (None: not differentiable, counts as zero)."""
    a = e.args
    x = a[0]
    u = lambda name: unary(name, x)
    if e.op in ("add", "subtract"):
        return [const(1), const(1 if e.op == "add" else -1)]
    if e.op == "multiply":
        return [a[1], x]
    if e.op == "divide":
        return [1 / a[1], -x / a[1] ** 2]
    if e.op == "modulo":
        return [const(1), -unary("truncate", x / a[1])]
    if e.op == "power":
        return [a[1] * x ** (a[1] - 1).simple(), None if a[1].op == "const" else e * u("log")]
    if e.op in ("max_elemwise", "min_elemwise"):
        first = where_greater(x, a[1], 1, 0) if e.op == "max_elemwise" else where_greater(a[1], x, 1, 0)
        return [first, 1 - first]
    if e.op == "where":
        one = where_greater(x, a[1], 1, 0)
        return [None, None, one, 1 - one]
    rules = {
        "plus": lambda: const(1), "negate": lambda: const(-1), "abs": lambda: u("sgn"), "log": lambda: 1 / x, "log10": lambda: 1 / (x * math.log(10)),
        "exp": lambda: e, "sin": lambda: u("cos"), "cos": lambda: -u("sin"), "tan": lambda: 1 + e**2, "asin": lambda: 1 / unary("sqrt", 1 - x**2),
        "acos": lambda: -1 / unary("sqrt", 1 - x**2), "atan": lambda: 1 / (1 + x**2), "sinh": lambda: u("cosh"), "cosh": lambda: u("sinh"),
        "tanh": lambda: 1 - e**2, "sqrt": lambda: 1 / (2 * e),
    }
    return [rules[e.op]() if e.op in rules else None]
