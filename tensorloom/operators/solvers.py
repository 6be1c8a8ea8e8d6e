"""Iterative solvers: driver loops over distributed vectors (keys..., re, im); only scalars reach the driver.

Each iterate is kept in the shared folder, so plans stay short and a lost executor costs no earlier iteration. A solver's
`after` is called with every iterate and its number.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx
from tensorloom.operators.linop import Linop, identity, inner, plus
from tensorloom.operators.prox import Prox, combine, keys_of, scaled, zero
from tensorloom.sources.storage import checkpointed, written

Map = Callable[[DataFrame], DataFrame]
After = Callable[[DataFrame, int], None] | None


def norm(x: DataFrame) -> float:
    return math.sqrt(x.agg(F.sum(cplx().abs2())).first()[0] or 0.0)


def dot(a: DataFrame, b: DataFrame) -> float:
    """The real part of <a, b>."""
    return inner(a, b).first()["re"] or 0.0


def _told(x: DataFrame, k: int, after: After) -> DataFrame:
    if after:
        after(x, k)
    return x


def power_iteration(a: Map, x: DataFrame, rounds: int, after: After = None) -> tuple[float, DataFrame]:
    """(the last norm of A x, the last x of norm 1)."""
    size = norm(x)
    x = scaled(x, 1 / size)
    for k in range(rounds):
        y = checkpointed(a(x))
        size = norm(y)
        x = _told(scaled(y, 1 / size), k, after)
    return size, x


def conjugate_gradient(a: Map, b: DataFrame, x: DataFrame, rounds: int, tol: float = 0.0, precondition: Map = identity, after: After = None, prox: Map | None = None) -> DataFrame:
    """Solves A x = b for a positive definite A; stops at sqrt(r . z) <= tol, and raises if p . A p is not positive.

    With `prox`, each round's x goes through it, and the residual is that of the x that comes out.
    """
    r = checkpointed(combine(b, a(x), 1.0, -1.0))
    z = precondition(r)
    p, rz = z, dot(r, z)
    for k in range(rounds):
        if math.sqrt(max(rz, 0.0)) <= tol:
            break
        ap = checkpointed(a(p))
        pap = dot(p, ap)
        if pap <= 0:
            raise ArithmeticError(f"the operator is not positive definite: p . A p = {pap}")
        step = rz / pap
        x = combine(x, p, 1.0, step)
        x = _told(checkpointed(prox(x) if prox else x), k, after)
        r = checkpointed(combine(b, a(x), 1.0, -1.0) if prox else combine(r, ap, 1.0, -step))
        z = precondition(r)
        before, rz = rz, dot(r, z)
        p = checkpointed(combine(z, p, 1.0, rz / before))
    return x


def gradient_descent(gradient: Map, x: DataFrame, step: float, rounds: int, prox: Prox = zero, accelerated: bool = False, tol: float = 0.0, after: After = None) -> DataFrame:
    """x <- prox(z - step gradient(z)); accelerated (FISTA): z is x plus its last move times (t - 1) / t'. Stops when x moves by `tol` of its norm."""
    z, t = x, 1.0
    for k in range(rounds):
        new = written(prox(combine(z, gradient(z), 1.0, -step), step))
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2 if accelerated else 1.0
        pull = (t - 1) / t_next
        moved = tol and norm(combine(new, x, 1.0, -1.0)) <= tol * norm(new)
        z = combine(new, x, 1 + pull, -pull) if accelerated and pull else new
        x, t = _told(new, k, after), t_next
        if moved:
            break
    return x


def primal_dual(k: Linop, prox_f: Prox, prox_g_conjugate: Prox, x: DataFrame, y: DataFrame, tau: float, sigma: float, rounds: int, theta: float = 1.0, gamma: float = 0.0, after: After = None) -> DataFrame:
    """min f(x) + g(K x). With gamma > 0 (a strongly convex f) the steps adapt: theta = 1 / sqrt(1 + 2 gamma tau)."""
    bar = x
    for n in range(rounds):
        y = checkpointed(prox_g_conjugate(combine(y, k(bar), 1.0, sigma), sigma))
        new = checkpointed(prox_f(combine(x, k.H(y), 1.0, -tau), tau))
        if gamma:
            theta = 1 / math.sqrt(1 + 2 * gamma * tau)
            tau, sigma = tau * theta, sigma / theta
        bar = combine(new, x, 1 + theta, -theta)
        x = _told(new, n, after)
    return x


def primal_dual_gradient(gradient: Map, k: Linop, prox_g_conjugate: Prox, x: DataFrame, y: DataFrame, tau: float, sigma: float, rounds: int, tol: float = 0.0, after: After = None) -> DataFrame:
    """min f(x) + g(K x) for a smooth f, by its gradient and a dual variable; 1 / tau - sigma |K|^2 >= L / 2. Stops when x moves by `tol` of its norm."""
    for n in range(rounds):
        new = written(combine(combine(x, gradient(x), 1.0, -tau), k.H(y), 1.0, -tau))
        y = written(prox_g_conjugate(combine(y, k(combine(new, x, 2.0, -1.0)), 1.0, sigma), sigma))
        moved = tol and norm(combine(new, x, 1.0, -1.0)) <= tol * norm(new)
        x = _told(new, n, after)
        if moved:
            break
    return x


def admm(solve_x: Callable[[DataFrame], DataFrame], prox_z: Prox, z: DataFrame, rho: float, rounds: int, after: After = None) -> DataFrame:
    """min f(x) + g(z) with x = z: x from solve_x(z - u), z from the prox of g, u the running sum of x - z."""
    u = scaled(z, 0.0)
    for k in range(rounds):
        x = checkpointed(solve_x(combine(z, u, 1.0, -1.0)))
        shifted = checkpointed(combine(x, u))
        z = checkpointed(prox_z(shifted, 1 / rho))
        u = checkpointed(combine(shifted, z, 1.0, -1.0))
        _told(x, k, after)
    return x


def batched_solve(a: Map, b: DataFrame, batch: list[str], rounds: int, x: DataFrame | None = None, tol: float = 0.0) -> DataFrame:
    """Solves A x = b by conjugate gradients, with step lengths of its own for each value of `batch`, all at once.

    A is a map of whole vectors that keeps batches apart. A batch rests where its residual is at most `tol` times its b, or
    where p . A p is not positive; the others go on, for `rounds` at most. The scalars are grouped sums joined back, never
    driver values, and each round keeps one table in the shared folder. Entries that A leaves out are zero.
    """
    keys = keys_of(b)
    z, other, ap = cplx("r"), cplx("p"), cplx("a")
    start = b.select(*keys, F.lit(0.0).alias("xre"), F.lit(0.0).alias("xim"), F.col("re").alias("rre"), F.col("im").alias("rim"))
    if x is not None:
        known = x.select(*keys, F.col("re").alias("xre"), F.col("im").alias("xim"))
        left = combine(b, plus(scaled(b, 0.0), a(x)), 1.0, -1.0).select(*keys, F.col("re").alias("rre"), F.col("im").alias("rim"))
        start = left.join(known, keys).select(*keys, "xre", "xim", "rre", "rim")
    state = checkpointed(start.withColumns({"pre": F.col("rre"), "pim": F.col("rim")}))
    sizes = checkpointed(b.groupBy(*batch).agg((F.sum(cplx().abs2()) * (tol * tol)).alias("_least")))
    for _ in range(rounds):
        image = a(state.select(*keys, F.col("pre").alias("re"), F.col("pim").alias("im"))).select(*keys, F.col("re").alias("are"), F.col("im").alias("aim"))
        both = checkpointed(state.join(image, keys, "left").na.fill(0.0, ["are", "aim"]))
        sums = both.groupBy(*batch).agg(F.sum(z.abs2()).alias("_rr"), F.sum((other.conj() * ap).re).alias("_pap"), F.sum((z.conj() * ap).re).alias("_ra"), F.sum(ap.abs2()).alias("_aa")).join(sizes, batch)
        step = F.when((F.col("_rr") > F.col("_least")) & (F.col("_pap") > 0), F.col("_rr") / F.col("_pap")).otherwise(F.lit(0.0))
        sums = checkpointed(sums.withColumn("_step", step))
        if tol and not sums.where("_step > 0").head(1):
            break
        # the next residual's size by the same sums: what cancels is of this round's size
        turn = F.greatest(F.lit(0.0), 1 - 2 * F.col("_step") * F.col("_ra") / F.col("_rr") + F.col("_step") * F.col("_step") * F.col("_aa") / F.col("_rr"))
        rates = sums.select(*batch, "_step", F.when(F.col("_step") > 0, turn).otherwise(F.lit(0.0)).alias("_turn"))
        moved = both.join(rates, batch).withColumns({f"x{c}": F.col(f"x{c}") + F.col("_step") * F.col(f"p{c}") for c in ("re", "im")} | {f"r{c}": F.col(f"r{c}") - F.col("_step") * F.col(f"a{c}") for c in ("re", "im")})
        state = moved.select(*keys, "xre", "xim", "rre", "rim", *[(F.col(f"r{c}") + F.col("_turn") * F.col(f"p{c}")).alias(f"p{c}") for c in ("re", "im")])
    return checkpointed(state.select(*keys, F.col("xre").alias("re"), F.col("xim").alias("im")))


@dataclass(frozen=True)
class Term:
    """g(K x), by the prox of g."""

    prox: Prox
    k: Linop = identity


def consensus(a: Map, b: DataFrame, terms: list[Term], batch: list[str], rho: float, rounds: int, inner_rounds: int, tol: float = 0.0, inner_tol: float = 0.0, after: After = None) -> DataFrame:
    """min 1/2 <x, A x> - re <b, x> + the sum of g(K x) over the terms: each term has a copy z of K x, and a dual u, of its own.

    x solves (A + rho times the sum of K^H K) x = b + rho times the sum of K^H (z - u), all batches at once (`batched_solve`,
    from the last x on); z is the prox of K x + u at 1 / rho, and u what is left of it. Starts at x = 0. Stops when all K x are
    within `tol` of their z, and x moves by `tol` of its norm. The copies and duals live in the shared folder.
    """
    x = checkpointed(scaled(b, 0.0))
    copies = [checkpointed(term.k(x)) for term in terms]
    duals = list(copies)
    op = lambda v: plus(a(v), *[scaled(t.k.N(v), rho) for t in terms])
    for n in range(rounds):
        right = checkpointed(plus(b, *[scaled(t.k.H(combine(z, u, 1.0, -1.0)), rho) for t, z, u in zip(terms, copies, duals, strict=True)]))
        new = _told(batched_solve(op, right, batch, inner_rounds, x, inner_tol), n, after)
        apart = 0.0
        for i, term in enumerate(terms):
            there = checkpointed(term.k(new))
            shifted = checkpointed(combine(there, duals[i]))
            copies[i] = checkpointed(term.prox(shifted, 1 / rho))
            duals[i] = checkpointed(combine(shifted, copies[i], 1.0, -1.0))
            if tol:
                apart = max(apart, norm(combine(there, copies[i], 1.0, -1.0)) / max(norm(there), 1e-300))
        rests = tol and apart <= tol and norm(combine(new, x, 1.0, -1.0)) <= tol * norm(new)
        x = new
        if rests:
            break
    return x


def batched_conjugate_gradient(matrices: DataFrame, rhs: DataFrame, batch: str, rounds: int, tol: float = 0.0) -> DataFrame:
    """One solve for each value of `batch`, all at once: the scalars are grouped sums joined back, not driver values.

    `matrices` has (batch, row, col, v), `rhs` (batch, i, b); gives (batch, i, x). A batch that has converged, or whose
    p . A p is not positive, stays where it is.
    """
    state = checkpointed(rhs.select(batch, "i", F.lit(0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("p")))
    for _ in range(rounds):
        ap = matrices.join(state.select(batch, F.col("i").alias("col"), "p"), [batch, "col"]).groupBy(batch, F.col("row").alias("i")).agg(F.sum(F.col("v") * F.col("p")).alias("ap"))
        both = checkpointed(state.join(ap, [batch, "i"]))
        sums = both.groupBy(batch).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("p") * F.col("ap")).alias("pap"))
        step = F.when((F.sqrt("rr") > tol) & (F.col("pap") > 0), F.col("rr") / F.col("pap")).otherwise(F.lit(0.0))
        moved = both.join(sums, batch).withColumn("_a", step).select(batch, "i", (F.col("x") + F.col("_a") * F.col("p")).alias("x"), (F.col("r") - F.col("_a") * F.col("ap")).alias("r"), "p", "rr")
        moved = checkpointed(moved)
        again = moved.groupBy(batch).agg(F.sum(F.col("r") * F.col("r")).alias("_rr"))
        beta = F.col("_rr") / F.nullif(F.col("rr"), F.lit(0.0))
        state = checkpointed(moved.join(again, batch).select(batch, "i", "x", "r", (F.col("r") + F.coalesce(beta, F.lit(0.0)) * F.col("p")).alias("p")))
    return state.select(batch, "i", "x")
