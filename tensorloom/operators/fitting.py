"""Least squares: polynomials by sums of powers, small solves in closed form, and non-linear fits of batches of problems."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.dual import Dual, over_arrays

# small symmetric systems as column expressions


def ldl(a: list[list[Column]]) -> tuple[list[list[Column]], list[Column]]:
    """L (unit lower) and D with A = L D L^T, of the lower triangle `a`; null where a pivot is zero."""
    n = len(a)
    low: list[list[Column]] = [[F.lit(0.0)] * n for _ in range(n)]
    d: list[Column] = []
    for j in range(n):
        pivot = a[j][j]
        for k in range(j):
            pivot = pivot - low[j][k] * low[j][k] * d[k]
        d.append(F.nullif(pivot, F.lit(0.0)))
        for i in range(j + 1, n):
            x = a[i][j]
            for k in range(j):
                x = x - low[i][k] * low[j][k] * d[k]
            low[i][j] = x / d[j]
    return low, d


def ldl_solve(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Forward substitution, division by D, backward substitution."""
    low, d = ldl(a)
    n = len(b)
    y: list[Column] = []
    for i in range(n):
        v = b[i]
        for k in range(i):
            v = v - low[i][k] * y[k]
        y.append(v)
    x: list[Column] = [F.lit(None)] * n
    for i in range(n - 1, -1, -1):
        v = y[i] / d[i]
        for k in range(i + 1, n):
            v = v - low[k][i] * x[k]
        x[i] = v
    return x


def polyfit(df: DataFrame, x: str, y: str, degree: int, *groups: str) -> DataFrame:
    """(groups, c0, c1, ...) per group, by the normal equations: sums of powers about the group's mean, expanded back.

    The means come from a pass of their own, and meet the rows by a join on the group. Rows with a null or non-finite x or y go.
    Groups with fewer distinct x than coefficients have no answer: null.
    """
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    rows = df.where(finite(x) & finite(y)).select(F.struct(*groups).alias("_g") if groups else F.lit(0).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    means = rows.groupBy("_g").agg(F.avg("_x").alias("_mean"))
    rows = rows.join(means, "_g").withColumn("_x", F.col("_x") - F.col("_mean"))
    powers = [F.sum(F.pow(F.col("_x"), F.lit(float(k)))).alias(f"_p{k}") for k in range(2 * degree + 1)]
    moments = [F.sum(F.pow(F.col("_x"), F.lit(float(k))) * F.col("_y")).alias(f"_m{k}") for k in range(degree + 1)]
    sums = rows.groupBy("_g", "_mean").agg(*powers, *moments, F.count_distinct("_x").alias("_n"))
    solved = ldl_solve([[F.col(f"_p{i + j}") for j in range(i + 1)] for i in range(degree + 1)], [F.col(f"_m{k}") for k in range(degree + 1)])
    sums = sums.select("_g", "_n", "_mean", *[c.alias(f"_c{k}") for k, c in enumerate(solved)])
    back = [sum((F.col(f"_c{k}") * (math.comb(k, j) * F.pow(-F.col("_mean"), F.lit(float(k - j)))) for k in range(j, degree + 1)), F.lit(0.0)) for j in range(degree + 1)]
    return sums.select(*[F.col(f"_g.{g}").alias(g) for g in groups], *[F.when(F.col("_n") > degree, c).alias(f"c{k}") for k, c in enumerate(back)])


# non-linear fits: one row is one problem, its data in arrays


@dataclass(frozen=True)
class Damping:
    """How the second-order damped Newton steps are accepted, and how their damping changes."""

    start: float = 5.0
    accept: float = 1e-3
    good: float = 0.75
    shrink: float = 0.5
    grow: float = 4.0
    rounds: int = 60
    tol: float = 1e-8


def modified_cholesky(h: np.ndarray, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, d) for a batch of symmetric H (n x k x k): H[order][:, order] + E = low diag(d) low^T, with E diagonal and not negative.

    Gill, Murray and Wright's factor with diagonal pivoting: each step takes the largest remaining diagonal entry, and raises
    its pivot so far that it is positive and no row of low sqrt(d) grows beyond a bound from H's own entries. For an H that is
    positive definite enough, E is zero. The steps are over columns; all matrices of the batch take each together.
    """
    n, k = h.shape[:2]
    c, each, low, d = h.astype(float).copy(), np.arange(n), np.zeros((n, k, k)), np.empty((n, k))
    order = np.tile(np.arange(k), (n, 1))
    diagonal = np.abs(np.einsum("nii->ni", c)).max(axis=1)
    beside = np.abs(c * (1 - np.eye(k))).max(axis=(1, 2))
    least = eps * np.maximum(diagonal + beside, 1)
    bound = np.maximum.reduce([diagonal, beside / math.sqrt(max(1, k * k - 1)), np.full(n, eps)])
    for j in range(k):
        pivot = j + np.abs(np.einsum("nii->ni", c)[:, j:]).argmax(axis=1)
        for x in (order, c, c.transpose(0, 2, 1), low):
            x[each, j], x[each, pivot] = x[each, pivot].copy(), x[each, j].copy()
        rest = c[:, j + 1 :, j]
        largest = np.abs(rest).max(axis=1, initial=0.0)
        d[:, j] = np.maximum.reduce([np.abs(c[:, j, j]), largest * largest / bound, least])
        low[:, j, j] = 1
        low[:, j + 1 :, j] = rest / d[:, j, None]
        c[:, j + 1 :, j + 1 :] -= low[:, j + 1 :, j, None] * rest[:, None, :]
    return order, low, d


def substituted(order: np.ndarray, low: np.ndarray, d: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of the factored system: forward substitution, division by the pivots, backward substitution, places put back."""
    y = np.take_along_axis(b, order, axis=1)
    for j in range(y.shape[1]):
        y[:, j + 1 :] -= low[:, j + 1 :, j] * y[:, j, None]
    y /= d
    for j in range(y.shape[1] - 1, -1, -1):
        y[:, :j] -= low[:, j, :j] * y[:, j, None]
    x = np.empty_like(y)
    np.put_along_axis(x, order, y, axis=1)
    return x


def safeguarded_solve(h: np.ndarray, g: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Steps -(H + E)^-1 g for a batch of symmetric H (n x k x k) by `modified_cholesky`: always downhill.

    Rows and columns are first divided by the powers of two nearest to the roots of the diagonal's magnitudes, so that parameters
    of unlike sizes count alike; that division is exact.
    """
    size = np.sqrt(np.abs(np.einsum("nii->ni", h)))
    size = np.exp2(np.rint(np.log2(np.where(size > 0, size, 1))))
    return substituted(*modified_cholesky(h / (size[:, :, None] * size[:, None, :]), eps), -g / size) / size


def solve_rows(df: DataFrame, matrix: str, rhs: str, key: str) -> DataFrame:
    """(key, x, d): x = (H + E)^-1 b of each row's symmetric matrix (k * k numbers by rows) and right side (k numbers), d the raised pivots.

    Batches of rows of one k are factored together where they are. Rows with a null, or a matrix that is not k x k, get nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = pdf[rhs].map(lambda v: np.asarray(v if v is not None else [], float))
            h = pdf[matrix].map(lambda v: np.asarray(v if v is not None else [], float))
            fits = [len(x) if len(x) and len(m) == len(x) ** 2 and np.isfinite(x).all() and np.isfinite(m).all() else 0 for x, m in zip(b, h, strict=True)]
            for k, part in pdf.groupby(fits):
                if not k:
                    yield part[[key]].assign(x=None, d=None)
                    continue
                order, low, d = modified_cholesky(np.stack(h[part.index].to_list()).reshape(-1, k, k))
                x = substituted(order, low, d, np.stack(b[part.index].to_list()))
                yield part[[key]].assign(x=list(x), d=list(d))

    return df.select(key, matrix, rhs).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, x array<double>, d array<double>")


def _objective(model: Callable[..., Dual], names: list[str], p: np.ndarray, consts: dict[str, np.ndarray], data: np.ndarray):
    """f (half the sum of squared residuals), gradient and Hessian for each problem of the batch."""
    out = over_arrays(model, names, **{n: p[:, i, None] for i, n in enumerate(names)}, **consts)
    full = lambda x: np.broadcast_to(x, data.shape)
    r = full(out.value) - data
    jac = [full(out.d.get(n, 0.0)) for n in names]
    f = 0.5 * (r * r).sum(axis=1)
    g = np.stack([(r * j).sum(axis=1) for j in jac], axis=1)
    h = np.empty((len(p), len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            second = out.h.get((a, b), out.h.get((b, a), 0.0))
            h[:, i, j] = h[:, j, i] = (jac[i] * jac[j] + r * full(second)).sum(axis=1)
    return f, g, h


def damped_newton(model: Callable[..., Dual], names: list[str], p: np.ndarray, consts: dict[str, np.ndarray], data: np.ndarray, lower: np.ndarray, upper: np.ndarray, rule: Damping = Damping()) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, objective) of a batch, from the starts `p`: Hessian plus damping, steps kept if they gain what they promise.

    Steps that are not finite count as zero; parameters are clamped to the box, and one that its gradient holds at a bound is left
    out of the step: the others would go where it cannot follow. A problem rests, and is computed no more,
    once its projected gradient promises less than `tol` of half the squared data, or a kept step moves its parameters by
    less than `tol`; the others go on for `rounds` at most.
    """
    p = np.clip(p, lower, upper)
    value = np.empty(len(p))
    live = np.arange(len(p))
    own, y, lam = dict(consts), data, np.full(len(p), rule.start)
    f, g, h = _objective(model, names, p, own, y)
    at, size = p.copy(), 0.5 * (y * y).sum(axis=1) + 1e-300
    eye = np.eye(p.shape[1])
    for _ in range(rule.rounds):
        scale = np.maximum(np.abs(np.einsum("nii->ni", h)), 1e-12)
        damped = h + lam[:, None, None] * scale[:, :, None] * eye
        held = ((at <= lower) & (g > 0)) | ((at >= upper) & (g < 0))
        damped = np.where(held[:, :, None] | held[:, None, :], eye * scale[:, :, None], damped)
        pull = np.where(held, 0, g)
        ok = np.isfinite(damped).all(axis=(1, 2)) & np.isfinite(g).all(axis=1)
        step = np.zeros_like(at)
        if ok.any():
            step[ok] = safeguarded_solve(damped[ok], pull[ok])
        step[~np.isfinite(step)] = 0
        new = np.clip(at + step, lower, upper)
        step = new - at
        f_new, g_new, h_new = _objective(model, names, new, own, y)
        promised = -(g * step).sum(axis=1) - 0.5 * np.einsum("ni,nij,nj->n", step, h, step)
        with np.errstate(all="ignore"):
            ratio = (f - f_new) / np.where(promised > 0, promised, np.inf)
        keep = np.isfinite(f_new) & (f_new < f) & ((ratio > rule.accept) | (promised <= 0))
        still = keep & (np.abs(step) <= rule.tol * (np.abs(at) + rule.tol)).all(axis=1)
        lam = np.where(keep & (ratio > rule.good), lam * rule.shrink, np.where(keep, lam, lam * rule.grow)).clip(1e-12, 1e12)
        at, f = np.where(keep[:, None], new, at), np.where(keep, f_new, f)
        g, h = np.where(keep[:, None], g_new, g), np.where(keep[:, None, None], h_new, h)
        projected = np.where((at <= lower) & (g > 0), 0, np.where((at >= upper) & (g < 0), 0, g))
        rests = still | ((np.abs(projected) * (np.abs(at) + 1e-3)).max(axis=1) <= rule.tol * rule.tol * size) | (lam >= 1e12)
        p[live[rests]], value[live[rests]] = at[rests], f[rests]
        live, lam, at, f, g, h, y, size = (x[~rests] for x in (live, lam, at, f, g, h, y, size))
        own = {n: c[~rests] for n, c in own.items()}
        if not len(live):
            break
    p[live], value[live] = at, f
    return p, value


def fit(df: DataFrame, model: Callable[..., Dual], names: list[str], data: str, consts: list[str], start: dict[str, float | str], lower: dict[str, float], upper: dict[str, float], key: str, restarts: int = 1, seed: int = 0, rule: Damping = Damping()) -> DataFrame:
    """(key, names..., objective): each row's parameters fitted to its array `data` (constants: arrays of that length, or numbers).

    A start is a number or the name of a column that holds it. Batches of rows are solved side by side in numpy where they are; nothing is shuffled. `restarts` more starts are
    drawn from the box by a hash of the key; the best end is kept, ties to the first. Rows without data, or with a null
    in them, get nulls. All arrays of a batch that are as long as each other are solved together.
    """
    low, high = np.asarray([lower[n] for n in names]), np.asarray([upper[n] for n in names])
    given = sorted({v for v in start.values() if isinstance(v, str)})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.stack([np.asarray(v, float) for v in pdf[data]])
        c = {n: np.stack([np.asarray(v, float) for v in pdf[n]]) if np.ndim(pdf[n].iloc[0]) else pdf[n].to_numpy(float)[:, None] for n in consts}
        at = np.column_stack([pdf[start[n]].to_numpy(float) if isinstance(start[n], str) else np.full(len(pdf), float(start[n])) for n in names])
        best, value = damped_newton(model, names, np.where(np.isfinite(at), at, (low + high) / 2), c, y, low, high, rule)
        for k in range(1, restarts):
            draw = np.stack([np.random.default_rng([seed, k, int(x) & 0xFFFFFFFF]).random(len(names)) for x in pdf[key]])
            p, f = damped_newton(model, names, low + draw * (high - low), c, y, low, high, rule)
            wins = f < value
            best, value = np.where(wins[:, None], p, best), np.where(wins, f, value)
        return pd.DataFrame({key: pdf[key], **{n: best[:, i] for i, n in enumerate(names)}, "objective": value})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf[data].map(lambda v: len(v) if v is not None and np.isfinite(np.asarray(v, float)).all() else 0)
            for n, part in pdf.groupby(size):
                yield solve(part) if n else part[[key]].assign(**{x: None for x in (*names, "objective")})

    kinds = ", ".join(f"{n} double" for n in names)
    return df.select(key, data, *consts, *given).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {kinds}, objective double")


def objective_surface(df: DataFrame, objective: Callable[..., Column], grids: dict[str, list[float]], key: str) -> DataFrame:
    """(key, names..., objective) at every point of a grid of parameters."""
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df.select(key, *grids, objective(**{n: F.col(n) for n in grids}).alias("objective"))


def random_search(df: DataFrame, objective: Callable[..., Column], lower: dict[str, float], upper: dict[str, float], draws: int, key: str, seed: int = 0) -> DataFrame:
    """(key, names..., objective): of `draws` hash draws from the box, the one with the smallest objective (ties: the smallest parameters).

    A row's draws are compared within the row: none of them is a row, sorted or sent. Rows of one key are one
    problem. Rows are first dealt to all cores: a small file of many rows would keep one busy.
    """
    names = list(lower)

    def tried(k: Column) -> Column:
        u = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed + i), key, k), 11) / float(1 << 53)
        return F.struct(*[(F.lit(lower[n]) + u(i) * (upper[n] - lower[n])).alias(n) for i, n in enumerate(names)])

    def judged(p: Column) -> Column:
        return F.struct(objective(**{n: p[n] for n in names}).alias("objective"), *[p[n].alias(n) for n in names])

    draw = F.transform(F.sequence(F.lit(1), F.lit(draws)), tried)
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = df.repartition(parts, key).select(key, F.array_min(F.transform(draw, judged)).alias("_b"))
    best = own.groupBy(key).agg(F.min("_b").alias("_b"))
    return best.select(key, *[f"_b.{n}" for n in names], "_b.objective")
