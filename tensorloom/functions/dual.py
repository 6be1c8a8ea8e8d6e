"""Values with first and second derivatives, carried through arithmetic: over Spark columns, or over numpy arrays.

A model is a Python function of such values, so it is written once with +, -, *, / and ** and the functions below; its
value, gradient and Hessian come out as expressions that Catalyst compiles (`over_columns`), or as arrays (`over_arrays`).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import functions as F


class Columns:
    """Functions of Spark columns. Logarithms of what is not positive and divisions by zero are null."""

    exp, sqrt, sin, cos, tan, asin, acos, atan = F.exp, F.sqrt, F.sin, F.cos, F.tan, F.asin, F.acos, F.atan
    sinh, cosh, tanh, asinh, acosh, atanh = F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh
    log, abs = F.ln, F.abs

    @staticmethod
    def sign(x):
        return F.signum(x)

    @staticmethod
    def power(x, y):
        return F.pow(x, y if not isinstance(y, int | float) else F.lit(float(y)))

    @staticmethod
    def divide(x, y):
        y = F.lit(float(y)) if isinstance(y, int | float) else y
        return x / F.nullif(y, F.lit(0.0))


class Arrays:
    """Functions of numpy arrays."""

    exp, sqrt, sin, cos, tan, asin, acos, atan = np.exp, np.sqrt, np.sin, np.cos, np.tan, np.arcsin, np.arccos, np.arctan
    sinh, cosh, tanh, asinh, acosh, atanh = np.sinh, np.cosh, np.tanh, np.arcsinh, np.arccosh, np.arctanh
    log, abs, sign, power, divide = np.log, np.abs, np.sign, np.power, np.divide


def _sum(*terms):
    """The sum of the terms that are there; None stands for zero."""
    out = None
    for t in terms:
        if t is not None:
            out = t if out is None else out + t
    return out


def _times(*factors):
    """The product; zero (None) if a factor is zero."""
    out = 1
    for f in factors:
        if f is None:
            return None
        out = f if isinstance(out, int) and out == 1 else out * f
    return out


class Dual:
    """A value, its gradient by variable and the lower triangle of its Hessian; entries that are zero are left out."""

    def __init__(self, value: Any, ops, d: dict[str, Any] | None = None, h: dict[tuple[str, str], Any] | None = None):
        self.value, self.ops, self.d, self.h = value, ops, d or {}, h or {}

    def _of(self, o) -> Dual:
        return o if isinstance(o, Dual) else Dual(o, self.ops)

    def _pairs(self, *others: Dual) -> list[tuple[str, str]]:
        names = sorted(set(self.d).union(*[o.d for o in others]))
        return [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]

    def _chain(self, value, first, second) -> Dual:
        """f(self) from f, f' and f''."""
        d = {a: _times(first, x) for a, x in self.d.items()}
        h = {p: _sum(_times(first, self.h.get(p)), _times(second, self.d.get(p[0]), self.d.get(p[1]))) for p in self._pairs()}
        return Dual(value, self.ops, d, {p: x for p, x in h.items() if x is not None})

    def _linear(self, o: Dual, value, sign: int) -> Dual:
        def both(x, y):
            return _sum(x, None if y is None else sign * y)

        d = {a: both(self.d.get(a), o.d.get(a)) for a in {*self.d, *o.d}}
        h = {p: both(self.h.get(p), o.h.get(p)) for p in {*self.h, *o.h}}
        return Dual(value, self.ops, d, h)

    def __neg__(self) -> Dual:
        return self * -1.0

    def __add__(self, o) -> Dual:
        o = self._of(o)
        return self._linear(o, self.value + o.value, 1)

    def __sub__(self, o) -> Dual:
        o = self._of(o)
        return self._linear(o, self.value - o.value, -1)

    def __mul__(self, o) -> Dual:
        o = self._of(o)
        d = {a: _sum(_times(self.d.get(a), o.value), _times(self.value, o.d.get(a))) for a in {*self.d, *o.d}}
        h = {}
        for a, b in self._pairs(o):
            x = _sum(
                _times(self.h.get((a, b)), o.value), _times(self.value, o.h.get((a, b))), _times(self.d.get(a), o.d.get(b)), _times(self.d.get(b), o.d.get(a))
            )
            if x is not None:
                h[a, b] = x
        return Dual(self.value * o.value, self.ops, d, h)

    def __truediv__(self, o) -> Dual:
        o = self._of(o)
        one = self.ops.divide(1.0, o.value)
        return self * o._chain(one, -1.0 * one * one, 2.0 * one * one * one)

    def __pow__(self, p) -> Dual:
        """Constant exponents by the power rule; others as e^(p ln x)."""
        if isinstance(p, Dual):
            return exp(p * log(self))
        f = self.ops.power
        return self._chain(f(self.value, p), p * f(self.value, p - 1), p * (p - 1) * f(self.value, p - 2))

    def __radd__(self, o) -> Dual:
        return self + o

    def __rmul__(self, o) -> Dual:
        return self * o

    def __rsub__(self, o) -> Dual:
        return self._of(o) - self

    def __rtruediv__(self, o) -> Dual:
        return self._of(o) / self

    def __rpow__(self, base: float) -> Dual:
        return exp(self * math.log(base))


def _function(name: str, derivatives: Callable) -> Callable[[Dual], Dual]:
    def f(x: Dual) -> Dual:
        value = getattr(x.ops, name)(x.value)
        return x._chain(value, *derivatives(x.value, value, x.ops))

    f.__name__ = name
    return f


exp = _function("exp", lambda x, y, f: (y, y))
log = _function("log", lambda x, y, f: (f.divide(1.0, x), -1.0 * f.divide(1.0, x * x)))
sqrt = _function("sqrt", lambda x, y, f: (f.divide(0.5, y), -1.0 * f.divide(0.25, y * x)))
abs_ = _function("abs", lambda x, y, f: (f.sign(x), None))
sign = _function("sign", lambda x, y, f: (None, None))
sin = _function("sin", lambda x, y, f: (f.cos(x), -1.0 * y))
cos = _function("cos", lambda x, y, f: (-1.0 * f.sin(x), -1.0 * y))
tan = _function("tan", lambda x, y, f: (1 + y * y, 2.0 * y * (1 + y * y)))
asin = _function("asin", lambda x, y, f: (f.divide(1.0, f.sqrt(1 - x * x)), f.divide(x, f.power(1 - x * x, 1.5))))
acos = _function("acos", lambda x, y, f: (-1.0 * f.divide(1.0, f.sqrt(1 - x * x)), -1.0 * f.divide(x, f.power(1 - x * x, 1.5))))
atan = _function("atan", lambda x, y, f: (f.divide(1.0, 1 + x * x), f.divide(-2.0 * x, (1 + x * x) * (1 + x * x))))
sinh = _function("sinh", lambda x, y, f: (f.cosh(x), y))
cosh = _function("cosh", lambda x, y, f: (f.sinh(x), y))
tanh = _function("tanh", lambda x, y, f: (1 - y * y, -2.0 * y * (1 - y * y)))
asinh = _function("asinh", lambda x, y, f: (f.divide(1.0, f.sqrt(1 + x * x)), -1.0 * f.divide(x, f.power(1 + x * x, 1.5))))
acosh = _function("acosh", lambda x, y, f: (f.divide(1.0, f.sqrt(x * x - 1)), -1.0 * f.divide(x, f.power(x * x - 1, 1.5))))
atanh = _function("atanh", lambda x, y, f: (f.divide(1.0, 1 - x * x), f.divide(2.0 * x, (1 - x * x) * (1 - x * x))))


def _variables(values: dict, varying: list[str], ops) -> dict[str, Dual]:
    return {n: Dual(v, ops, {n: 1.0} if n in varying else None) for n, v in values.items()}


def over_columns(model: Callable[..., Dual], varying: list[str], **columns) -> Dual:
    """The model of columns; derivatives by the `varying` ones. `.value`, `.d[name]` and `.h[a, b]` (a >= b by name) are columns."""
    return model(**_variables(columns, varying, Columns))


def over_arrays(model: Callable[..., Dual], varying: list[str], **arrays) -> Dual:
    return model(**_variables(arrays, varying, Arrays))
