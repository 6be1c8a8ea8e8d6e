"""Batched solves over operators, and consensus of several terms, beside plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx
from tensorloom.operators import linop, prox, solvers

SIZES = {0: 5, 1: 8, 2: 3, 3: 4}


@pytest.fixture(scope="module")
def systems(spark):
    """Batches of unequal sizes and conditions: (map, b as a table, matrices, right sides); batch 3 has b = 0."""
    rng = np.random.default_rng(8)
    matrices, rights, cells, entries = {}, {}, [], []
    for g, n in SIZES.items():
        m = rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n))
        matrices[g] = m @ m.conj().T * 10.0**g + np.eye(n)
        rights[g] = (rng.normal(size=n) + 1j * rng.normal(size=n)) * (g < 3)
        cells += [(g, i, j, float(matrices[g][i, j].real), float(matrices[g][i, j].imag)) for i in range(n) for j in range(n)]
        entries += [(g, i, float(v.real), float(v.imag)) for i, v in enumerate(rights[g])]
    table = spark.createDataFrame(cells, "g int, row int, i int, mre double, mim double")
    z = cplx("m") * cplx()

    def a(x):
        return table.join(x, ["g", "i"]).groupBy("g", F.col("row").alias("i")).agg(F.sum(z.re).alias("re"), F.sum(z.im).alias("im"))

    return a, spark.createDataFrame(entries, "g int, i int, re double, im double"), matrices, rights


def vectors(df):
    out = {g: np.zeros(n, complex) for g, n in SIZES.items()}
    for r in df.collect():
        out[r["g"]][r["i"]] = complex(r["re"], r["im"])
    return out


def plain(m, b, x, rounds):
    r = b - m @ x
    p = r
    for _ in range(rounds):
        rr = np.vdot(r, r).real
        if not rr:
            break
        ap = m @ p
        step = rr / np.vdot(p, ap).real
        x, r = x + step * p, r - step * ap
        p = r + np.vdot(r, r).real / rr * p
    return x


def test_each_batch_takes_steps_of_its_own(systems):
    a, b, matrices, rights = systems
    for start in (None, b):
        got = vectors(solvers.batched_solve(a, b, ["g"], 3, start))
        for g, m in matrices.items():
            want = plain(m, rights[g], rights[g] if start is not None else np.zeros(len(m)), 3)
            assert np.allclose(got[g], want, rtol=1e-7, atol=1e-9)


def test_batches_rest_once_they_are_solved(systems):
    a, b, matrices, rights = systems
    calls = []
    got = vectors(solvers.batched_solve(lambda x: (calls.append(1), a(x))[1], b, ["g"], 60, tol=1e-8))
    assert len(calls) < 40
    for g, m in matrices.items():
        assert np.linalg.norm(m @ got[g] - rights[g]) <= 1e-7 * np.linalg.norm(rights[g]) and np.isfinite(got[g]).all()
    assert not got[3].any()


def shrink(x, t):
    return x * np.where(np.abs(x) > t, 1 - t / np.maximum(np.abs(x), 1e-300), 0)


def test_consensus_takes_the_steps_of_numpy(systems):
    a, b, matrices, rights = systems
    terms = [solvers.Term(prox.soft(0.3)), solvers.Term(prox.soft(0.1), linop.scale(0.5, 2.0))]
    got = vectors(solvers.consensus(a, b, terms, ["g"], 2.0, 3, 4))
    for g, m in matrices.items():
        n, ks = len(m), [1.0, 0.5 + 2.0j]
        x, z, u = np.zeros(n, complex), [np.zeros(n, complex)] * 2, [np.zeros(n, complex)] * 2
        for _ in range(3):
            right = rights[g] + sum(2.0 * np.conj(k) * (zk - uk) for k, zk, uk in zip(ks, z, u, strict=True))
            x = plain(m + 2.0 * sum(abs(k) ** 2 for k in ks) * np.eye(n), right, x, 4)
            shifted = [k * x + uk for k, uk in zip(ks, u, strict=True)]
            z = [shrink(s, lam / 2.0) for s, lam in zip(shifted, (0.3, 0.1), strict=True)]
            u = [s - zk for s, zk in zip(shifted, z, strict=True)]
        assert np.allclose(got[g], x, rtol=1e-6, atol=1e-9)


def test_consensus_stops_where_the_plain_loop_does(systems):
    a, b, matrices, rights = systems
    rounds = []
    got = vectors(solvers.consensus(a, b.where("g = 0"), [solvers.Term(prox.soft(0.2))], ["g"], 1.0, 6, 2, tol=0.3, after=lambda x, k: rounds.append(k)))[0]
    m = matrices[0] + np.eye(SIZES[0])
    x = z = u = np.zeros(SIZES[0], complex)
    for n in range(6):
        old, x = x, plain(m, rights[0] + z - u, x, 2)
        z = shrink(x + u, 0.2)
        u = u + x - z
        if max(np.linalg.norm(x - z), np.linalg.norm(x - old)) <= 0.3 * np.linalg.norm(x):
            break
    assert rounds == list(range(n + 1)) and 0 < n < 5
    assert np.allclose(got, x, rtol=1e-6, atol=1e-9)


def test_the_estimated_size_of_iterates_does_not_grow_with_the_rounds(spark):
    from tensorloom.operators import prox, solvers
    from tensorloom.operators.linop import identity

    b = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "i int, re double, im double")
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    gradient = lambda x: prox.combine(x, b, 1.0, -1.0)
    x = solvers.primal_dual_gradient(gradient, identity, prox.convex_conjugate(prox.soft(0.1)), b, prox.scaled(b, 0.0), 0.5, 0.5, 3)
    assert bits(x) < 32
    assert bits(solvers.gradient_descent(gradient, b, 0.5, 3, prox.soft(0.1), True)) < 32
