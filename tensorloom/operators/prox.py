"""Proximal operators on long-form vectors (keys..., re, im): each is a function of a vector and a step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx
from tensorloom.operators.linop import Linop

Prox = Callable[[DataFrame, float], DataFrame]


def keys_of(x: DataFrame) -> list[str]:
    return [c for c in x.columns if c not in ("re", "im")]


def combine(x: DataFrame, y: DataFrame, a: Column | float = 1.0, b: Column | float = 1.0) -> DataFrame:
    """a x + b y on equal keys, by an equal join."""
    keys = keys_of(x)
    other = y.select(*keys, F.col("re").alias("_re"), F.col("im").alias("_im"))
    return x.join(other, keys).select(*keys, *[(F.col(c) * a + F.col(f"_{c}") * b).alias(c) for c in ("re", "im")])


def scaled(x: DataFrame, s: float) -> DataFrame:
    return x.withColumns({c: F.col(c) * s for c in ("re", "im")})


def zero(x: DataFrame, alpha: float) -> DataFrame:
    """Of the zero function: x itself."""
    return x


def soft(lam: float) -> Prox:
    """Of lam |x|_1: magnitudes less lam alpha, not below zero, phases kept."""

    def run(x: DataFrame, alpha: float) -> DataFrame:
        size = cplx().abs()
        shrink = F.when(size > lam * alpha, 1 - lam * alpha / F.nullif(size, F.lit(0.0))).otherwise(F.lit(0.0))
        return x.withColumn("_s", shrink).withColumns({c: F.col(c) * F.col("_s") for c in ("re", "im")}).drop("_s")

    return run


def convex_conjugate(p: Prox) -> Prox:
    """x - alpha prox_{1/alpha}(x / alpha)."""
    return lambda x, alpha: combine(x, p(scaled(x, 1 / alpha), 1 / alpha), 1.0, -alpha)


def postcomposition(p: Prox, factor: float) -> Prox:
    """Of factor f + constant: prox_{factor alpha}(x)."""
    return lambda x, alpha: p(x, factor * alpha)


def precomposition(p: Prox, a: float, b: float) -> Prox:
    """Of f(a x + b): (prox_{a^2 alpha}(a x + b) - b) / a."""

    def run(x: DataFrame, alpha: float) -> DataFrame:
        inner = x.withColumns({"re": F.col("re") * a + b, "im": F.col("im") * a})
        return p(inner, a * a * alpha).withColumns({"re": (F.col("re") - b) / a, "im": F.col("im") / a})

    return run


def unitary(p: Prox, q: Linop) -> Prox:
    """Of f(Q x): Q^H prox(Q x)."""
    return lambda x, alpha: q.H(p(q(x), alpha))


def affine(p: Prox, a: DataFrame) -> Prox:
    """Of f(x) + <a, x>: prox(x - alpha a)."""
    return lambda x, alpha: p(combine(x, a, 1.0, -alpha), alpha)


def l2_regularised(p: Prox, rho: float, a: DataFrame | None = None) -> Prox:
    """Of f(x) + rho / 2 |x - a|^2: prox_{alpha / (1 + alpha rho)}((x + alpha rho a) / (1 + alpha rho))."""

    def run(x: DataFrame, alpha: float) -> DataFrame:
        c = 1 + alpha * rho
        near = combine(x, a, 1 / c, alpha * rho / c) if a is not None else scaled(x, 1 / c)
        return p(near, alpha / c)

    return run


def block_low_rank(lam: float, axes: tuple[str, ...], rows: list[str], extent: tuple[int, ...], size: int, shift: tuple[int, ...] | None = None) -> Prox:
    """Of lam times the nuclear norms of disjoint blocks: their singular values less lam alpha."""
    from tensorloom.operators.blocks import svt_pass

    return lambda x, alpha: svt_pass(x, axes, rows, size, size, shift or (0,) * len(axes), extent, lam * alpha)


def l1_dct(transform: Linop, lam: float) -> Prox:
    """Soft thresholds in the (orthonormal) cosine domain."""
    return unitary(soft(lam), transform)
