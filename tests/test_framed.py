"""Framed reconstruction beside plain numpy: dense matrices of each frame, the same steps."""

import math

import numpy as np
import pytest

from tensorloom.operators import framed
from tensorloom.operators.blocks import threshold
from tensorloom.plans import reconstruction

SIZES = {"x": 5, "y": 4, "z": 3}
SHAPE = tuple(SIZES.values())
FRAMES, COILS = 3, 2


@pytest.fixture(scope="module")
def case(spark):
    """Ragged frames: (freqs, maps, samples) as tables, and (A, y, truth) of each frame as arrays."""
    rng = np.random.default_rng(5)
    cells = [tuple(int(i - n // 2) for i, n in zip(at, SHAPE, strict=True)) for at in np.ndindex(SHAPE)]
    maps = rng.normal(size=(COILS, len(cells))) + 1j * rng.normal(size=(COILS, len(cells)))
    base = rng.normal(size=(2, len(cells))) + 1j * rng.normal(size=(2, len(cells)))
    freqs, samples, frames = [], [], []
    for f in range(FRAMES):
        k = rng.uniform(-math.pi, math.pi, (90 + 25 * f, 3))
        turn = np.exp(-1j * k @ np.array(cells).T)
        a = np.concatenate([turn * s for s in maps])
        truth = base[0] + f * base[1]
        y = a @ truth
        freqs += [(f, i, *map(float, p)) for i, p in enumerate(k)]
        samples += [(f, c, i, *map(float, p), float(y[c * len(k) + i].real), float(y[c * len(k) + i].imag)) for c in range(COILS) for i, p in enumerate(k)]
        frames.append((a, y, truth, len(k)))
    ks = "kx double, ky double, kz double"
    table = spark.createDataFrame([(c, *at, float(maps[c, j].real), float(maps[c, j].imag)) for c in range(COILS) for j, at in enumerate(cells)], "coil int, x int, y int, z int, sre double, sim double")
    return spark.createDataFrame(freqs, f"frame int, s int, {ks}"), table, spark.createDataFrame(samples, f"frame int, coil int, s int, {ks}, re double, im double"), frames, maps


def dense(df):
    out = np.zeros((FRAMES, *SHAPE), complex)
    for r in df.collect():
        out[(r["frame"], *(r[a] + n // 2 for a, n in SIZES.items()))] = complex(r["re"], r["im"])
    return out.reshape(FRAMES, -1)


def low_rank(x, amount, size, call):
    """Blocks of `size` at the shift of the call; the rest passes."""
    v = x.reshape(FRAMES, *SHAPE).copy()
    shift = [min(call % size, n % size + size - 1) for n in SHAPE]
    counts = [(n - s) // size for n, s in zip(SHAPE, shift, strict=True)]
    for at in np.ndindex(*counts):
        cut = (slice(None), *(slice(s + b * size, s + (b + 1) * size) for s, b in zip(shift, at, strict=True)))
        v[cut] = threshold(v[cut].reshape(FRAMES, -1), amount, True).reshape(v[cut].shape)
    return v.reshape(FRAMES, -1)


def near(a, b, tol=2e-3):
    assert np.linalg.norm(a - b) < tol * np.linalg.norm(b)


@pytest.fixture(scope="module")
def solved(case):
    freqs, maps, samples, *_ = case
    return framed.problem(samples, maps, freqs, SIZES)


def test_problem_is_the_normal_operator(spark, case, solved):
    (freqs, maps, samples, frames, _), p = case, solved
    start = np.stack([a.conj().T @ y / n for a, y, _, n in frames])
    near(dense(p.start), start)
    near(dense(p.normal(p.start)), np.stack([a.conj().T @ (a @ b) / n for (a, _, _, n), b in zip(frames, start, strict=True)]))
    largest = max(np.linalg.eigvalsh(a.conj().T @ a)[-1] / n for a, _, _, n in frames)
    assert largest <= p.bound <= 1.3 * largest
    image = spark.createDataFrame([(r["frame"], r["x"], r["y"], r["z"], r["re"], r["im"]) for r in p.start.collect()], p.start.schema)
    values = {(r["frame"], r["coil"], r["s"]): complex(r["re"], r["im"]) for r in framed.forward(image, maps, freqs, SIZES).collect()}
    for f, (a, _, _, n) in enumerate(frames):
        want = a @ start[f]
        near(np.array([values[f, c, i] for c in range(COILS) for i in range(n)]), want)


def test_descent_takes_the_steps_of_numpy(case, solved):
    frames, p = case[3], solved
    lam = 0.02 * p.bound
    got = dense(framed.descend(p, framed.local_low_rank(lam, SIZES, 2), rounds=3, tol=0.0))
    step, t = 1 / p.bound, 1.0
    b = np.stack([a.conj().T @ y / n for a, y, _, n in frames])
    x = z = step * b
    for k in range(3):
        g = np.stack([a.conj().T @ (a @ v) / n for (a, _, _, n), v in zip(frames, z, strict=True)]) - b
        new = low_rank(z - step * g, lam * step, 2, k)
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t_next * (new - x), new, t_next
    near(got, x)


def test_primal_dual_takes_the_steps_of_numpy(case, solved):
    frames, p = case[3], solved
    lam = 0.02 * p.bound
    got = dense(framed.primal_dual(p, framed.local_low_rank(lam, SIZES, 2), rounds=3, tol=0.0))
    sigma = 0.1 * p.bound
    tau = 1 / (p.bound / 2 + sigma)
    b = np.stack([a.conj().T @ y / n for a, y, _, n in frames])
    x, y = b / p.bound, np.zeros_like(b)
    for k in range(3):
        g = np.stack([a.conj().T @ (a @ v) / n for (a, _, _, n), v in zip(frames, x, strict=True)]) - b
        new = x - tau * g - tau * y
        moved = y + sigma * (2 * new - x)
        y = moved - sigma * low_rank(moved / sigma, lam / sigma, 2, k)
        x = new
    near(got, x)


def test_alternating_takes_the_steps_of_numpy(case, solved):
    frames, p = case[3], solved
    lam, rho = 0.02 * p.bound, 0.1 * p.bound
    got = dense(framed.alternating(p, framed.tilings(lam, SIZES, 2), rho, 2, 2, tol=0.0))
    b = np.stack([a.conj().T @ y / n for a, y, _, n in frames])
    x, none = np.zeros_like(b), np.zeros_like(b)
    z, u = [none, none], [none, none]
    for _ in range(2):
        right = b + rho * sum(zk - uk for zk, uk in zip(z, u, strict=True))
        for f, (a, _, _, n) in enumerate(frames):
            m = a.conj().T @ a / n + 2 * rho * np.eye(a.shape[1])
            r = right[f] - m @ x[f]
            d = r
            for _ in range(2):
                step = np.vdot(r, r).real / np.vdot(d, m @ d).real
                x[f] = x[f] + step * d
                after = r - step * (m @ d)
                d, r = after + np.vdot(after, after).real / np.vdot(r, r).real * d, after
        shifted = [x + uk for uk in u]
        z = [low_rank(s, lam / 2 / rho, 2, k) for k, s in enumerate(shifted)]
        u = [s - zk for s, zk in zip(shifted, z, strict=True)]
    near(got, x)


def test_gridding_is_the_weighted_adjoint(case):
    freqs, maps, samples, frames, s = case
    got = dense(framed.gridded(samples, maps, freqs, SIZES, rounds=0))  # equal weights
    want = np.stack([a.conj().T @ y / n for a, y, _, n in frames]) / (np.abs(s) ** 2).sum(0)
    near(got, want)


@pytest.mark.parametrize("query, most", [("framed_reconstruction", 0.1), ("framed_primal_dual", 0.1), ("framed_alternating", 0.1), ("framed_gridding", 0.5)])
def test_queries_recover_the_truth(spark, sf_dir, query, most):
    errors = getattr(reconstruction, query)(spark, sf_dir).collect()
    assert len(errors) == 3 and all(r.relative_error < most for r in errors), errors


def test_frames_are_ragged_and_whole(spark, sf_dir):
    truth, maps, freqs, samples = reconstruction._inputs(spark, sf_dir)
    upper = 2 * spark.read.parquet(f"{sf_dir}/events.parquet").agg({"value": "avg"}).first()[0]
    assert freqs.count() == spark.read.parquet(f"{sf_dir}/events.parquet").where(f"value < {upper}").count()
    assert maps.count() == 320 and truth.count() == 96 and samples.count() == 10 * freqs.count()
    assert len({r["count"] for r in freqs.groupBy("frame").count().collect()}) == 3
