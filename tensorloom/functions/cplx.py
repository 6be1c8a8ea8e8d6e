"""Complex arithmetic on pairs of double columns; Spark has no complex type."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Cplx(NamedTuple):
    re: Column
    im: Column

    def __add__(self, o: Cplx) -> Cplx:
        return Cplx(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Cplx) -> Cplx:
        return Cplx(self.re - o.re, self.im - o.im)

    def __mul__(self, o: Cplx) -> Cplx:
        return Cplx(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o: Cplx) -> Cplx:
        """Null where the divisor is zero."""
        d = F.nullif(o.re * o.re + o.im * o.im, F.lit(0.0))
        top = self * o.conj()
        return Cplx(top.re / d, top.im / d)

    def __neg__(self) -> Cplx:
        return Cplx(-self.re, -self.im)

    def scale(self, s) -> Cplx:
        return Cplx(self.re * s, self.im * s)

    def conj(self) -> Cplx:
        return Cplx(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())

    def angle(self) -> Column:
        return F.atan2(self.im, self.re)


def cplx(prefix: str = "", re: str = "re", im: str = "im") -> Cplx:
    return Cplx(F.col(prefix + re), F.col(prefix + im))


def cis(theta: Column) -> Cplx:
    """e^(i theta)."""
    return Cplx(F.cos(theta), F.sin(theta))
