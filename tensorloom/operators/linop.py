"""Composable linear operators on long-form vectors (child?, i, re, im), with adjoints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx

Map = Callable[[DataFrame], DataFrame]


def contract(matrix: DataFrame, x: DataFrame, row: str, col: str, *batch: str, conj: bool = False) -> DataFrame:
    """y[row] = sum over col of m[row, col] x[col]: a join on the contracted index and a sum over the other.

    The matrix has (row, col, mre, mim), the vector (batch..., i, re, im). Sums are partial before the shuffle by row.
    """
    m = cplx("m")
    z = (m.conj() if conj else m) * cplx()
    products = matrix.join(x, matrix[col] == x["i"]).select(*batch, F.col(row).alias("i"), z.re.alias("re"), z.im.alias("im"))
    return products.groupBy(*batch, "i").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


@dataclass(frozen=True)
class Linop:
    """A pair of maps; `@` composes, `+`, `-` and scalars combine."""

    forward: Map
    backward: Map | None = None

    def __call__(self, x: DataFrame) -> DataFrame:
        return self.forward(x)

    @cached_property
    def H(self) -> Linop:
        if self.backward is None:
            raise TypeError("the operator has no adjoint")
        return Linop(self.backward, self.forward)

    @cached_property
    def N(self) -> Linop:
        return self.H @ self

    def __matmul__(self, o: Linop) -> Linop:
        back = (lambda y: o.backward(self.backward(y))) if self.backward and o.backward else None
        return Linop(lambda x: self.forward(o.forward(x)), back)

    def __add__(self, o: Linop) -> Linop:
        back = (lambda y: plus(self.backward(y), o.backward(y))) if self.backward and o.backward else None
        return Linop(lambda x: plus(self.forward(x), o.forward(x)), back)

    def __sub__(self, o: Linop) -> Linop:
        return self + scale(-1.0) @ o

    def __rmul__(self, s: float) -> Linop:
        return scale(s) @ self


def plus(*xs: DataFrame) -> DataFrame:
    """The sum of vectors: union, then one grouped sum; absent entries are zero."""
    keys = [c for c in xs[0].columns if c not in ("re", "im")]
    return reduce(DataFrame.unionByName, xs).groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def scale(s: float, im: float = 0.0) -> Linop:
    def times(a: float, b: float) -> Map:
        return lambda x: x.withColumns({"re": F.col("re") * a - F.col("im") * b, "im": F.col("re") * b + F.col("im") * a})

    return Linop(times(s, im), times(s, -im))


identity = Linop(lambda x: x, lambda x: x)
negative = scale(-1.0)


def matrix(m: DataFrame) -> Linop:
    """(row, col, mre, mim) as an operator."""
    return Linop(lambda x: contract(m, x, "row", "col", *_batch(x)), lambda y: contract(m, y, "col", "row", *_batch(y), conj=True))


def _batch(x: DataFrame) -> list[str]:
    return [c for c in x.columns if c not in ("i", "re", "im")]


def diagonal(d: DataFrame) -> Linop:
    """(i, mre, mim): entry by entry."""

    def times(conj: bool) -> Map:
        def run(x: DataFrame) -> DataFrame:
            m = cplx("m")
            z = (m.conj() if conj else m) * cplx()
            return x.join(d, "i").select(*_batch(x), "i", z.re.alias("re"), z.im.alias("im"))

        return run

    return Linop(times(False), times(True))


def along(op: Linop, axis: str) -> Linop:
    """An operator on i applied along another index column; the others are batch keys."""

    def turned(f: Map) -> Map:
        return lambda x: f(x.withColumnRenamed(axis, "i")).withColumnRenamed("i", axis)

    return Linop(turned(op.forward), turned(op.backward) if op.backward else None)


def translation(b: DataFrame, op: Linop = identity, sign: float = 1.0) -> Linop:
    """op(x) + sign b; not linear, so without an adjoint."""
    return Linop(lambda x: plus(op(x), scale(sign)(b)))


def regularised(op: Linop, lam: float) -> Linop:
    """A + lambda I."""
    return op + scale(lam)


def vstack(*ops: Linop) -> Linop:
    """[A1 x, ..., An x], the results keyed by child; the adjoint sums."""

    def forward(x: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [op(x).withColumn("child", F.lit(k)) for k, op in enumerate(ops)])

    def backward(y: DataFrame) -> DataFrame:
        return plus(*[op.backward(y.where(F.col("child") == k).drop("child")) for k, op in enumerate(ops)])

    return Linop(forward, backward if all(op.backward for op in ops) else None)


def hstack(*ops: Linop) -> Linop:
    """The sum of Ai xi over the children; the adjoint stacks."""
    turned = vstack(*[Linop(op.backward or op.forward, op.forward) for op in ops])
    return Linop(turned.backward, turned.forward if all(op.backward for op in ops) else None)


def inner(a: DataFrame, b: DataFrame) -> DataFrame:
    """<a, b> as one row (re, im)."""
    keys = [c for c in a.columns if c not in ("re", "im")]
    right = b.select(*keys, F.col("re").alias("_re"), F.col("im").alias("_im"))
    z = cplx().conj() * cplx("_")
    return a.join(right, keys).agg(F.sum(z.re).alias("re"), F.sum(z.im).alias("im"))


def gram(vectors: DataFrame, array: str = "embedding") -> DataFrame:
    """A^T A of the rows of an array column: (row, col, v), each row's products summed before any shuffle."""
    pairs = vectors.select(F.posexplode(array).alias("row", "a"), F.col(array).alias("_all")).select("row", "a", F.posexplode("_all").alias("col", "b"))
    return pairs.groupBy("row", "col").agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("v"))
