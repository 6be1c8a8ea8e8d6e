"""The pivoted modified Cholesky factor beside a plain loop, and the steps that it gives."""

import math

import numpy as np

from tensorloom.operators import fitting


def plain(h, eps=1e-12):
    """One matrix, entry by entry."""
    k = len(h)
    h = h.copy()
    order = list(range(k))
    top = max(abs(h[i, i]) for i in range(k))
    off = max([abs(h[i, j]) for i in range(k) for j in range(i)], default=0.0)
    bound, least = max(top, off / math.sqrt(max(1, k * k - 1)), eps), eps * max(top + off, 1)
    low, d = np.zeros((k, k)), np.zeros(k)
    for j in range(k):
        q = max(range(j, k), key=lambda i: (abs(h[i, i]), -i))
        swap = list(range(k))
        swap[j], swap[q] = q, j
        h, low, order = h[np.ix_(swap, swap)], low[swap], [order[i] for i in swap]
        widest = max([abs(h[i, j]) for i in range(j + 1, k)], default=0.0)
        d[j] = max(abs(h[j, j]), widest**2 / bound, least)
        low[j, j] = 1
        for i in range(j + 1, k):
            low[i, j] = h[i, j] / d[j]
        for i in range(j + 1, k):
            for m in range(j + 1, k):
                h[i, m] -= low[i, j] * low[m, j] * d[j]
    return order, low, d


def batch(rng, n, k):
    h = rng.normal(size=(n, k, k))
    return h + h.transpose(0, 2, 1)


def test_factor_equals_the_plain_loop():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 5, 8):
        h = batch(rng, 40, k)
        h[0] = 0
        h[1] = np.eye(k)
        before = h.copy()
        order, low, d = fitting.modified_cholesky(h)
        assert (h == before).all()
        for i in range(len(h)):
            o, m, e = plain(h[i])
            assert list(order[i]) == o and np.allclose(low[i], m) and np.allclose(d[i], e)
            raised = m @ np.diag(d[i]) @ m.T - h[i][np.ix_(o, o)]
            assert np.abs(raised - np.diag(np.diag(raised))).max() < 1e-9 and np.diag(raised).min() > -1e-9
            bound = max(np.abs(np.diag(h[i])).max(), np.abs(h[i] - np.diag(np.diag(h[i]))).max() / math.sqrt(max(1, k * k - 1)), 1e-12)
            assert ((np.tril(m, -1) ** 2) * d[i]).max() <= bound * (1 + 1e-9)


def test_positive_definite_matrices_are_solved_as_they_are():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 6, 6))
    h, g = a @ a.transpose(0, 2, 1) + 0.5 * np.eye(6), rng.normal(size=(50, 6))
    order, low, d = fitting.modified_cholesky(h)
    back = low @ (d[:, :, None] * low.transpose(0, 2, 1))
    assert np.allclose(back, np.stack([x[np.ix_(o, o)] for x, o in zip(h, order, strict=True)]))
    assert np.allclose(fitting.safeguarded_solve(h, g), -np.linalg.solve(h, g[:, :, None])[:, :, 0])


def test_steps_go_downhill_at_any_scale():
    rng = np.random.default_rng(3)
    h, g = batch(rng, 200, 4), rng.normal(size=(200, 4))
    h[0], g[1] = 0, 0
    units = np.exp2([-20, 0, 10, 20])
    for scale in (np.ones(4), units):
        step = fitting.safeguarded_solve(h * scale[:, None] * scale, g * scale)
        assert np.isfinite(step).all() and ((step * g * scale).sum(axis=1)[g.any(axis=1)] < 0).all()
    assert np.allclose(fitting.safeguarded_solve(h * units[:, None] * units, g * units)[2:] * units, fitting.safeguarded_solve(h, g)[2:])


def test_rows(spark):
    eye = [1.0, 0.0, 0.0, 4.0]
    rows = [(1, eye, [1.0, 2.0]), (2, None, [1.0, 2.0]), (3, eye, None), (4, [1.0, 2.0, 3.0], [1.0, 2.0]), (5, [-2.0], [6.0]), (6, [float("nan"), 0.0, 0.0, 1.0], [1.0, 1.0]), (7, [], []), (8, [1.0, None, 0.0, 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k int, h array<double>, b array<double>")
    got = {r["k"]: r["x"] for r in fitting.solve_rows(df, "h", "b", "k").collect()}
    assert got == {1: [1.0, 0.5], 2: None, 3: None, 4: None, 5: [3.0], 6: None, 7: None, 8: None}
    assert fitting.solve_rows(df.limit(0), "h", "b", "k").count() == 0


def test_parameters_held_at_a_bound_do_not_stall_the_others():
    from tensorloom.plans.models import _BOX, biexponential

    names, b = ["s0", "f", "d1", "d2"], np.array([[0.0, 0.2, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0]])
    start, low, high = (np.array([x[n] for n in names]) for x in _BOX)
    for truth in ([1.56, 0.35, 1.5, 0.1], [1.82, 0.3, 1.5, 0.1]):
        s0, f, d1, d2 = truth
        y = s0 * (f * np.exp(-b * d1) + (1 - f) * np.exp(-b * d2))
        assert np.allclose(fitting.damped_newton(biexponential, names, start[None], {"b": b}, y, low, high)[0], truth, atol=1e-6)


def test_random_search_makes_no_row_of_a_draw_and_keeps_the_draws(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k % 4, float(k)) for k in range(5)], "k long, t double")
    loss = lambda a, b: (a - F.col("t")) ** 2 + b * b
    found = fitting.random_search(df, loss, {"a": 0.0, "b": -1.0}, {"a": 5.0, "b": 1.0}, 50, "k", seed=7)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    u = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(7 + i), "k", "_k"), 11) / float(1 << 53)
    tries = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumns({"a": u(0) * 5.0, "b": u(1) * 2.0 - 1.0})
    want = tries.groupBy("k").agg(F.min(F.struct(loss(F.col("a"), F.col("b")).alias("o"), "a", "b")).alias("m")).select("k", "m.a", "m.b", "m.o")
    assert np.allclose(sorted(map(tuple, found.collect())), sorted(map(tuple, want.collect())), rtol=1e-12)
