"""Vectors in long form: rows of (child, index columns, re[, im]); a tree has one child key, a leaf none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import Cplx, cplx


@dataclass(frozen=True)
class Tensor:
    """A DataFrame with the names of its index columns, its child column (None: a leaf) and its value columns."""

    df: DataFrame
    index: tuple[str, ...]
    child: str | None = None
    values: tuple[str, ...] = ("re",)

    @property
    def keys(self) -> list[str]:
        return ([self.child] if self.child else []) + list(self.index)

    def select(self, *values: Column, names: tuple[str, ...] | None = None) -> Tensor:
        names = names or self.values
        return replace(self, df=self.df.select(*self.keys, *[v.alias(n) for v, n in zip(values, names, strict=True)]), values=names)

    # element-wise
    def map(self, f: Callable[[Column], Column]) -> Tensor:
        return self.select(*[f(F.col(v)) for v in self.values])

    def neg(self) -> Tensor:
        return self.map(lambda v: -v)

    def scale(self, s: float) -> Tensor:
        return self.map(lambda v: v * F.lit(float(s)))

    def pow(self, p: float) -> Tensor:
        return self.map(lambda v: F.pow(v, F.lit(float(p))))

    def complex(self) -> Cplx:
        return cplx() if len(self.values) == 2 else Cplx(F.col("re"), F.lit(0.0))

    def abs(self) -> Tensor:
        return self.select(self.complex().abs(), names=("re",))

    def real(self) -> Tensor:
        return self.select(F.col("re"), names=("re",))

    def imag(self) -> Tensor:
        return self.select(F.col("im"), names=("re",))

    def angle(self) -> Tensor:
        return self.select(self.complex().angle(), names=("re",))

    def conj(self) -> Tensor:
        return self.select(*self.complex().conj()) if len(self.values) == 2 else self

    def sanitize(self, fill: float = 0.0) -> Tensor:
        """NaN and infinities replaced."""
        return self.map(lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(fill)).otherwise(v))

    def require_finite(self) -> Tensor:
        """The same tensor; reading a NaN or an infinity from it raises."""
        bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
        return self.map(lambda v: F.when(bad(v), F.raise_error(F.lit("a value is not finite")).cast("double")).otherwise(v))

    def reciprocal(self) -> Tensor:
        """1 / x, with 1 in the place of 0."""
        return self.map(lambda v: 1.0 / F.when(v == 0, F.lit(1.0)).otherwise(v))

    # trees
    def at(self, *children) -> Tensor:
        """One child as a leaf, several as a tree."""
        kept = self.df.where(F.col(self.child).isin(*children))
        return replace(self, df=kept.drop(self.child), child=None) if len(children) == 1 else replace(self, df=kept)

    def zip(self, other: Tensor, op: Callable[[Cplx, Cplx], Cplx]) -> Tensor:
        """Leaf with leaf and tree with tree by equal keys; a leaf meets every child of a tree.

        The join is on index columns, so Spark shuffles by them or broadcasts the side that is small enough.
        """
        tree, leaf, swapped = (self, other, False) if self.child or not other.child else (other, self, True)
        on = tree.keys if leaf.child else list(tree.index)
        right = leaf.df.select(*on, F.col("re").alias("_re"), (F.col("im") if len(leaf.values) == 2 else F.lit(0.0)).alias("_im"))
        a, b = tree.complex(), cplx("_")
        out = op(b, a) if swapped else op(a, b)
        both = len(tree.values) == 2 or len(leaf.values) == 2
        joined = replace(tree, df=tree.df.join(right, on))
        return joined.select(out.re, out.im, names=("re", "im")) if both else joined.select(out.re, names=("re",))

    def __add__(self, o: Tensor) -> Tensor:
        return self.zip(o, lambda a, b: a + b)

    def __sub__(self, o: Tensor) -> Tensor:
        return self.zip(o, lambda a, b: a - b)

    def __mul__(self, o: Tensor) -> Tensor:
        return self.zip(o, lambda a, b: a * b)

    def __truediv__(self, o: Tensor) -> Tensor:
        if len(self.values) == len(o.values) == 1:
            return self.zip(o, lambda a, b: Cplx(a.re / F.nullif(b.re, F.lit(0.0)), b.im))
        return self.zip(o, lambda a, b: a / b)

    # reductions: partial sums before the shuffle, one row at the end
    def _by_child(self, *aggs: Column) -> DataFrame:
        return self.df.groupBy(*([self.child] if self.child else [])).agg(*aggs)

    def sum(self) -> DataFrame:
        return self.df.agg(*[F.sum(v).alias(v) for v in self.values])

    def mean(self) -> DataFrame:
        """The unweighted mean of the children's means."""
        return self._by_child(*[F.avg(v).alias(v) for v in self.values]).agg(*[F.avg(v).alias(v) for v in self.values])

    def mean_median(self) -> DataFrame:
        """The mean of the children's lower medians."""
        return self._by_child(F.expr("percentile_disc(0.5) within group (order by re)").alias("re")).agg(F.avg("re").alias("re"))

    def extremes(self) -> DataFrame:
        return self.df.agg(F.min("re").alias("min"), F.max("re").alias("max"))

    def numel(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def norm(self) -> DataFrame:
        """The sum of the children's Frobenius norms."""
        return self._by_child(F.sqrt(F.sum(self.complex().abs2())).alias("norm")).agg(F.sum("norm").alias("norm"))

    def vdot(self, other: Tensor) -> DataFrame:
        """The sum of conj(a) b over all entries."""
        return self.zip(other, lambda a, b: a.conj() * b).sum()

    def relative_error(self, other: Tensor) -> DataFrame:
        """|a - b| / |b| over leaves."""
        d = self.zip(other, lambda a, b: Cplx((a - b).abs2(), b.abs2()))
        d = d if len(d.values) == 2 else self.select(F.col("re"), F.lit(0.0), names=("re", "im")).zip(other, lambda a, b: Cplx((a - b).abs2(), b.abs2()))
        return d.df.agg((F.sqrt(F.sum("re")) / F.nullif(F.sqrt(F.sum("im")), F.lit(0.0))).alias("relative_error"))

    def item(self) -> float:
        rows = self.df.select("re").take(2)
        if self.child or len(rows) != 1:
            raise ValueError("item() needs a leaf of one entry")
        return rows[0]["re"]


def entries(vectors: DataFrame, value: str = "embedding", key: str = "vec_id", *keep: str) -> Tensor:
    """An array column in long form: the rows are the children, i the place."""
    df = vectors.select(key, *keep, F.posexplode(value).alias("i", "x")).select(key, *keep, "i", F.col("x").cast("double").alias("re"))
    return Tensor(df, ("i",), key)


def complex_entries(vectors: DataFrame, value: str = "embedding", key: str = "vec_id", *keep: str) -> Tensor:
    """Neighbours of an array column as real and imaginary parts."""
    n = F.size(value) / 2
    pairs = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(F.get(F.col(value), 2 * i).cast("double").alias("re"), F.get(F.col(value), 2 * i + 1).cast("double").alias("im")))
    df = vectors.select(key, *keep, F.posexplode(pairs).alias("i", "z")).select(key, *keep, "i", "z.re", "z.im")
    return Tensor(df, ("i",), key, ("re", "im"))
