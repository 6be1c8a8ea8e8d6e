"""Identities, edge cases and comparisons with numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import dual
from tensorloom.operators import blocks, fitting, gating, linop, ordering, prox, reductions, reshape, selection, sense, solvers, transforms, velocity
from tensorloom.operators.tensor import Tensor
from tensorloom.plans import iterative, linear, timing
from tensorloom.plans.shared import complex_vectors


def vector(spark, z):
    return spark.createDataFrame([(i, float(np.real(v)), float(np.imag(v))) for i, v in enumerate(z)], "i int, re double, im double")


def array(df, *keys):
    rows = sorted((tuple(r[k] for k in keys or ("i",)), complex(r["re"], r["im"])) for r in df.collect())
    return np.asarray([v for _, v in rows])


def operator(spark, m):
    rows = [(i, j, float(v.real), float(v.imag)) for i, row in enumerate(m) for j, v in enumerate(row)]
    return linop.matrix(spark.createDataFrame(rows, "row int, col int, mre double, mim double"))


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(3)


def test_adjoint_and_normal(spark, rng):
    m = rng.normal(size=(4, 6)) + 1j * rng.normal(size=(4, 6))
    x = rng.normal(size=6) + 1j * rng.normal(size=6)
    a = operator(spark, m)
    assert np.allclose(array(a(vector(spark, x))), m @ x)
    assert np.allclose(array(a.N(vector(spark, x))), m.conj().T @ m @ x)
    with pytest.raises(TypeError):
        _ = linop.translation(vector(spark, x)).H


def test_conjugate_gradient(spark, rng):
    m = rng.normal(size=(5, 5))
    m = m @ m.T + np.eye(5)
    b = rng.normal(size=5)
    x = solvers.conjugate_gradient(operator(spark, m.astype(complex)), vector(spark, b), vector(spark, b * 0), 8, tol=1e-10)
    assert np.allclose(array(x).real, np.linalg.solve(m, b))
    with pytest.raises(ArithmeticError):
        solvers.conjugate_gradient(linop.negative, vector(spark, b), vector(spark, b * 0), 2)


def test_prox_moreau(spark, rng):
    z = rng.normal(size=12) + 1j * rng.normal(size=12)
    x = vector(spark, z)
    p = prox.soft(0.7)
    both = prox.combine(p(x, 2.0), prox.scaled(prox.convex_conjugate(p)(prox.scaled(x, 0.5), 0.5), 2.0))
    assert np.allclose(array(both), z)
    assert np.allclose(array(prox.unitary(p, linop.identity)(x, 1.0)), array(p(x, 1.0)))


def test_gates_at_their_edges(spark):
    values = [0.0, 5.0, 9.999, 10.0, 50.0, 99.0, 100.0, 300.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value double")
    mean = np.mean([v for v in values if v is not None])
    gated = {r.id: r.frame for r in gating.gate_by_value(df, "value", 4).collect()}
    upper = 2 * mean
    assert {i for i, v in enumerate(values) if v is not None and v < upper} == set(gated)
    for i, frame in gated.items():
        at = math.floor((values[i] - 0.05 * upper) / ((upper - 0.05 * upper) / 4))
        assert frame == max(0, min(3, at))
    assert gating.gate_open_end(df, "value", 4).count() == 8


def test_closed_bins_share_their_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 3.141592), (2, -3.141592), (3, 3.2), (4, 1.0), (5, None)], "id int, phase double")
    got = sorted((r.id, r.frame) for r in gating.gate_closed_bins(df, "phase", 4).collect())
    assert got == [(0, 1), (0, 2), (1, 3), (2, 0), (4, 2)]


def breathing(n, every=40):
    t = np.arange(n)
    return 3 * np.cos(2 * np.pi * t / every + 0.7) + 20 * t / n + 5 * np.sin(2 * np.pi * t / n), np.angle(np.exp(1j * (2 * np.pi * t / every + 0.7)))


def off(a, b):
    return np.abs(np.angle(np.exp(1j * (a - b))))


@pytest.mark.parametrize("causal", [False, True])
def test_respiratory_phase_loses_the_drift(causal):
    """A drift that is larger than the oscillation: the oscillation's phase comes out."""
    signal, phase = breathing(4000)
    got = gating.analytic_phase(signal, 0.003, causal)
    assert np.median(off(got, phase)[400:-400]) < (0.2 if causal else 0.02)


def test_respiratory_phase_of_series(spark, sf_dir):
    """Each series is filtered forward and backward as the formula says; a long one in chunks is near the whole one."""
    rows = timing.signal(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t"), "value")
    got = {r.event_id: r.phase for r in gating.respiratory_phase(rows, "user_id", "t", "value", low=0.1, tie="event_id").collect()}
    pdf = rows.toPandas().sort_values(["t", "event_id"])
    assert len(got) == len(pdf)
    for _, part in pdf.groupby("user_id"):
        v = part["value"].to_numpy() - part["value"].mean()
        n, f = len(v), np.fft.fftfreq(len(v))
        if n > 1:
            s = np.fft.fft(v) * (1 - 1 / (1 + (f / 0.1) ** 4))
            s[f < 0] *= np.where(f[f < 0] == -0.5, 1, 0)
            s[(f > 0) & (f < 0.5)] *= 2
            assert off(np.angle(np.fft.ifft(s)), np.asarray([got[i] for i in part["event_id"]])).max() < 1e-6
    signal, phase = breathing(3000)
    long = spark.createDataFrame([(1, float(k), float(v)) for k, v in enumerate(signal)], "u int, t double, v double")
    out = np.asarray([r.phase for r in gating.respiratory_phase(long, "u", "t", "v", 0.003, chunk=1000, margin=400).orderBy("t").collect()])
    assert len(out) == 3000 and off(out, phase)[400:-400].max() < 0.05


def test_windowed_transforms_are_near_the_direct_ones(spark, sf_dir):
    modes, freqs = linear._modes(spark, sf_dir), linear._own_freqs(spark, sf_dir).select("vec_id", "s", "kn")
    direct = array(transforms.nufft2(modes, freqs, {"n": 32}), "vec_id", "s") / math.sqrt(32)
    near = array(linear.kb_nufft(spark, sf_dir), "vec_id", "s")
    assert np.linalg.norm(near - direct) < 1e-3 * np.linalg.norm(direct)
    normal = array(transforms.nufft_normal(modes, freqs, {"n": 32}), "vec_id", "n") / 32
    near = {(r.vec_id, r.x - 16): complex(r.re, r.im) for r in linear.kb_nufft_normal(spark, sf_dir).collect()}
    assert np.linalg.norm(np.asarray([v for _, v in sorted(near.items())]) - normal) < 1e-3 * np.linalg.norm(normal)


def test_windowed_transforms_in_three_dimensions(spark, sf_dir):
    modes, coords = linear._boxes(spark, sf_dir)
    sizes = linear.BOX
    shifted = modes.withColumns({a: F.col(a) - n // 2 for a, n in sizes.items()})
    radians = coords.withColumns({f"k{a}": F.col(f"k{a}") * (2 * math.pi / n) for a, n in sizes.items()})
    direct = array(transforms.nufft2(shifted, radians, sizes), "vec_id", "s") / math.sqrt(32)
    near = array(linear.kb_nufft_3d(spark, sf_dir), "vec_id", "s")
    assert len(near) == len(direct) and np.linalg.norm(near - direct) < 1e-3 * np.linalg.norm(direct)


def test_toeplitz_on_a_grid(spark, rng):
    sizes, maps = {"x": 8, "y": 6}, None
    freqs = spark.createDataFrame([(s, *map(float, rng.uniform(-math.pi, math.pi, 2))) for s in range(40)], "s int, kx double, ky double")
    cells = [(i - 4, j - 3) for i in range(8) for j in range(6)]
    image = spark.createDataFrame([(*c, *map(float, rng.normal(size=2))) for c in cells], "x int, y int, re double, im double")
    maps = spark.createDataFrame([(k, *c, *map(float, rng.normal(size=2))) for k in range(2) for c in cells], "coil int, x int, y int, sre double, sim double")
    spectrum = transforms.toeplitz_spectrum(freqs, sizes)
    for want, got in (
        (transforms.nufft_normal(image, freqs, sizes), transforms.toeplitz_apply(image, spectrum, sizes)),
        (sense.normal(image, maps, freqs, sizes), sense.toeplitz_normal(image, maps, spectrum, sizes)),
    ):
        want, got = array(want, "x", "y"), array(got, "x", "y")
        assert np.linalg.norm(want - got) < 1e-3 * np.linalg.norm(want)


def test_preconditioners(spark, rng):
    n, points = 8, rng.uniform(-math.pi, math.pi, 25)
    maps = rng.normal(size=(2, n)) + 1j * rng.normal(size=(2, n))
    table = spark.createDataFrame([(c, i - 4, float(maps[c, i].real), float(maps[c, i].imag)) for c in range(2) for i in range(n)], "coil int, n int, sre double, sim double")
    freqs = spark.createDataFrame([(s, float(k)) for s, k in enumerate(points)], "s int, kn double")
    e = np.exp(-1j * np.outer(points, np.arange(n) - 4))
    a = sum(np.diag(m.conj()) @ e.conj().T @ e @ np.diag(m) for m in maps)
    f = np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n) - 4) / n) / math.sqrt(n)
    got = {r.i: r.mre for r in sense.circulant_build(table, freqs, n).collect()}
    assert np.allclose([got[i] for i in range(n)], 1 / np.diag(f @ a @ f.conj().T).real)
    for r in sense.kspace_preconditioner(table, freqs, n).collect():
        total = sum(abs((e[r.s] * maps[r.coil] * m.conj() * e[t].conj()).sum()) ** 2 for t in range(25) for m in maps)
        assert np.isclose(r.p, (np.abs(maps[r.coil]) ** 2).sum() / total)


def test_alternating_maps_explain_the_samples(spark, rng):
    n = 8
    image = np.asarray(rng.uniform(1, 2, n))
    maps = np.asarray([np.ones(n), 1 + 0.5j * np.cos(np.arange(n) / 3)])
    maps = maps / np.sqrt((np.abs(maps) ** 2).sum(axis=0))
    table = lambda m: spark.createDataFrame([(c, i - 4, float(np.real(m[c][i])), float(np.imag(m[c][i]))) for c in range(2) for i in range(n)], "coil int, n int, sre double, sim double")
    freqs = spark.createDataFrame([(s, -math.pi + 2 * math.pi * s / 24) for s in range(24)], "s int, kn double")
    one = spark.createDataFrame([(i - 4, float(v), 0.0) for i, v in enumerate(image)], "n int, re double, im double")
    samples = sense.forward(one, table(maps), freqs, {"n": n}).join(freqs, "s").select("coil", "s", "kn", "re", "im")
    start = table([np.full(n, 0.7), np.full(n, 0.7 + 0.1j)])
    found, new = sense.alternate_maps(samples, start, freqs, {"n": n}, 2, 6)
    again = array(sense.forward(found, new, freqs, {"n": n}), "coil", "s")
    want = array(samples.select("coil", "s", "re", "im"), "coil", "s")
    first = array(sense.forward(found, start, freqs, {"n": n}), "coil", "s")
    assert np.linalg.norm(again - want) < 0.2 * np.linalg.norm(want) < np.linalg.norm(first - want) * 10


def test_conjugate_gradient_with_a_prox(spark, rng):
    """Each round's x is thresholded, and the residual is that of what comes out."""
    m = rng.normal(size=(6, 6))
    m, b = m @ m.T + 6 * np.eye(6), rng.normal(size=6)
    got = array(solvers.conjugate_gradient(operator(spark, m), vector(spark, b), prox.scaled(vector(spark, b), 0.0), 4, prox=lambda x: prox.soft(0.01)(x, 1.0)))
    x, r = np.zeros(6), b.copy()
    p = r.copy()
    for _ in range(4):
        step = (r @ r) / (p @ m @ p)
        x = x + step * p
        x = np.sign(x) * np.maximum(np.abs(x) - 0.01, 0)
        new = b - m @ x
        p = new + (new @ new) / (r @ r) * p
        r = new
    assert np.allclose(got, x)


def test_shifted_passes_take_every_frame(spark, sf_dir):
    want = array(iterative._frames(spark, sf_dir), "frame", "y", "x").reshape(-1, 4, 8)
    rng = np.random.default_rng(5)
    for k in range(4):
        shift = rng.integers(0, 3, 2) if k else (0, 0)
        for y in range(shift[0], 4 - 1, 2):
            for x in range(shift[1], 8 - 1, 2):
                part = want[:, y : y + 2, x : x + 2].reshape(len(want), 4)
                want[:, y : y + 2, x : x + 2] = blocks.threshold(part, 0.1, True).reshape(len(want), 2, 2)
    got = array(iterative.svt_shifted_passes(spark, sf_dir), "frame", "y", "x").reshape(-1, 4, 8)
    assert np.allclose(got, want, atol=1e-4)


def test_transform_identities(spark, rng):
    z = rng.normal(size=16) + 1j * rng.normal(size=16)
    x = vector(spark, z)
    centred = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(z), norm="ortho"))
    assert np.allclose(array(transforms.fft(spark, 16)(x)), centred)
    assert np.allclose(array(transforms.dct(spark, 16).N(x)), z)
    freqs = spark.createDataFrame([(s, float(k)) for s, k in enumerate(rng.uniform(-3, 3, 9))], "s int, kn double")
    y = rng.normal(size=9) + 1j * rng.normal(size=9)
    modes = x.select((F.col("i") - 8).alias("n"), "re", "im")
    samples = freqs.join(vector(spark, y).withColumnRenamed("i", "s"), "s")
    left = np.vdot(array(transforms.nufft2(modes, freqs, {"n": 16}), "s"), y)
    right = np.vdot(z, array(transforms.nufft1(samples, {"n": 16}), "n"))
    assert np.isclose(left, right)
    back = transforms.direct_dft_adjoint(vector(spark, y).select(F.col("i").cast("double").alias("w"), "re", "im"), spark.createDataFrame([(0, 0.3)], "t int, w double"))
    assert np.isclose(array(back, "t")[0], (y * np.exp(-0.3j * np.arange(9))).sum())


def test_sense_identities(spark, sf_dir):
    image, maps, freqs = linear._sense(spark, sf_dir)
    image = image.where("vec_id < 2")
    samples = sense.forward(image, maps, freqs, {"n": 32})
    normal = array(sense.normal(image, maps, freqs, {"n": 32}), "vec_id", "n")
    assert np.isclose(np.vdot(array(image, "vec_id", "n"), normal).real, (np.abs(array(samples, "vec_id", "coil", "s")) ** 2).sum())
    again = sense.normal_adjoint(samples.join(freqs, "s"), maps, freqs, {"n": 32})
    assert again.count() == samples.count()


def test_coil_compression_keeps_energy(spark, sf_dir):
    t = complex_vectors(spark, sf_dir).df.groupBy(F.col("label").alias("coil"), F.col("i").alias("s")).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    m = array(t, "coil", "s").reshape(-1, 32)
    few = array(sense.compress_coils(t, 4), "coil", "s").reshape(4, 32)
    assert np.allclose(np.linalg.svd(few, compute_uv=False), np.linalg.svd(m, compute_uv=False)[:4])


def test_block_thresholds(spark, sf_dir):
    cube = iterative._cube(spark, sf_dir)
    want = array(cube, "frame", "y", "x").reshape(40, 4, 8)
    for amount, soft in ((0.1, True), (2.0, False)):
        got = array(blocks.svt_pass(cube, ("y", "x"), ["frame"], 4, 4, (0, 0), (5, 9), amount, soft), "frame", "y", "x").reshape(40, 4, 8)
        for x in (0, 4):
            u, s, v = np.linalg.svd(want[:, :, x : x + 4].reshape(40, 16), full_matrices=False)
            s = np.maximum(s - amount, 0) if soft else np.where(np.arange(len(s)) < 2, s, 0)
            assert np.allclose(got[:, :, x : x + 4].reshape(40, 16), (u * s) @ v)
    skipped = array(blocks.svt_pass(cube, ("y", "x"), ["frame"], 4, 4, (0, 0), (4, 8), 0.1), "frame", "y", "x")
    assert np.allclose(skipped.reshape(40, 4, 8), want)  # a block that reaches the edge is left out
    values = {r["rank"]: r for r in iterative.svd_order_stats(spark, sf_dir).collect()}
    per = [np.linalg.svd(g, compute_uv=False) for g in _matrices(spark, sf_dir)]
    assert np.isclose(values[0]["largest"], max(s[0] for s in per), atol=1e-4)


def _matrices(spark, sf_dir):
    pdf = complex_vectors(spark, sf_dir).df.toPandas().sort_values(["label", "vec_id", "i"])
    return [(g["re"] + 1j * g["im"]).to_numpy().reshape(-1, 32) for _, g in pdf.groupby("label")]


FUNCTIONS = "exp log sqrt sin cos tan asin acos atan sinh cosh tanh asinh atanh".split()


@pytest.mark.parametrize("name", FUNCTIONS)
def test_second_derivatives(name):
    f = lambda u: getattr(dual, name)(u * u + u * 0.1)
    u, e = np.linspace(0.1, 0.8, 9), 1e-4
    y = dual.over_arrays(lambda u: f(u), ["u"], u=u)
    at = lambda d: dual.over_arrays(lambda u: f(u), [], u=u + d).value
    assert np.allclose(y.d["u"], (at(e) - at(-e)) / (2 * e), rtol=1e-5)
    assert np.allclose(y.h["u", "u"], (at(e) - 2 * at(0) + at(-e)) / e**2, rtol=1e-3, atol=1e-4)


def test_derivatives_where_they_are_not_defined(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (None,)], "u double")
    y = dual.over_columns(lambda u: 1 / u + dual.log(u), ["u"], u=F.col("u"))
    assert df.select(y.value.alias("v")).collect() == [(None,)] * 3


def test_fits_recover_parameters_and_skip_bad_rows(spark):
    b = [0.0, 0.5, 1.0, 2.0, 4.0]
    rows = [(1, [3 * math.exp(-0.7 * x) for x in b], b), (2, None, b), (3, [1.0, None, 1.0, 1.0, 1.0], b)]
    df = spark.createDataFrame(rows, "k long, y array<double>, b array<double>")
    got = {r.k: r for r in fitting.fit(df, lambda s, d, b: s * dual.exp(-(b * d)), ["s", "d"], "y", ["b"], {"s": 1.0, "d": 0.1}, {"s": 0.0, "d": 0.0}, {"s": 9.0, "d": 5.0}, "k").collect()}
    assert math.isclose(got[1].s, 3, rel_tol=1e-6) and math.isclose(got[1].d, 0.7, rel_tol=1e-6)
    assert got[2].s is None and got[3].s is None


def test_random_search(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(5)], "k long, t double")
    got = fitting.random_search(df, lambda a, b: (a - F.col("t")) ** 2 + b * b, {"a": 0.0, "b": -1.0}, {"a": 5.0, "b": 1.0}, 200, "k").collect()
    assert len(got) == 5 and all(abs(r.a - r.k) < 1 and r.objective < 0.5 for r in got)


def test_velocity_round_trip_and_missing_encodes(spark):
    v = spark.createDataFrame([(1, 2.0, 0.5, -0.4, 0.3), (2, 1.0, 0.0, 0.0, 0.0)], "s long, mag double, vx double, vy double, vz double")
    enc = velocity.encode(v, 2.0, "s").where(~((F.col("s") == 2) & (F.col("enc") == 3)))
    lin = {r.s: r for r in velocity.decode_linear(enc, 2.0, "s").collect()}
    non = {r.s: r for r in velocity.decode_nonlinear(enc, 2.0, "s").collect()}
    assert np.allclose([lin[1].vx, lin[1].vy, lin[1].vz, non[1].vx, non[1].mag], [0.5, -0.4, 0.3, 0.5, 2.0])
    assert lin[2].vx is None and non[2].vx is None


def test_trees(spark):
    t = Tensor(spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 8.0), ("b", 0, 10.0)], "c string, i int, re double"), ("i",), "c")
    assert t.mean().first()[0] == (15 / 4 + 10) / 2
    assert t.mean_median().first()[0] == (2 + 10) / 2  # lower medians
    assert t.norm().first()[0] == math.sqrt(85) + 10
    with pytest.raises(ValueError):
        t.item()
    leaf = Tensor(spark.createDataFrame([(0, 1.0), (1, 1.0)], "i int, re double"), ("i",))
    assert sorted(r.re for r in (leaf - t).df.collect()) == [-9.0, -1.0, 0.0]
    assert t.at("b").item() == 10.0


def test_zero_norm_and_empty_tables(spark):
    none = spark.createDataFrame([], "i int, re double, im double, sre double, sim double")
    assert reductions.coil_combine(none, "i", normalised=True).count() == 0
    assert reductions.rss(none, "i", floor=1e-5).count() == 0
    zero = spark.createDataFrame([(0, 0.0)], "i int, re double")
    assert reductions.normalise(zero, "re").first()["re"] is None
    assert gating.gate_by_value(spark.createDataFrame([], "id int, value double"), "value", 4).count() == 0
    assert transforms.gridding(spark.createDataFrame([], "s int, kx double, re double, im double"), {"x": 8}, 4.0, 5.0).count() == 0


def test_samples_that_wrap(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0, 0.0), (1, 7.5, 1.0, 0.0)], "s int, kx double, re double, im double")
    beta = transforms.kernel_shape()
    got = {r.x: r.re for r in transforms.gridding(df, {"x": 8}, 4.0, beta).collect()}
    assert set(got) == {6, 7, 0, 1, 2} and got[7] > got[6]


def test_order(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 2, 1, None or 0])], "id int, v double")
    assert [r.id for r in sorted(ordering.argsort(df, "v", "id").collect(), key=lambda r: r.position)] == [4, 1, 3, 2, 0]
    assert ordering.random_subset(df, "id", 3, 1).collect() == ordering.random_subset(df.repartition(3), "id", 3, 1).collect()


def test_selection_and_reshape(spark):
    cells = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(3) for x in range(4)], "y int, x int, re double")
    small = reshape.resize_centre(cells, {"y": (3, 1), "x": (4, 2)})
    assert sorted((r.y, r.x, r.re) for r in small.collect()) == [(0, 0, 11.0), (0, 1, 12.0)]
    assert selection.subset(cells, cells.where("x > 5"), "x").count() == 0
    zoomed = {r.x: r.re for r in reshape.zoom_linear(cells.where("y = 0").drop("y"), "x", 4, 7, "re").collect()}
    assert zoomed == {i: i / 2 for i in range(7)}


def test_batched_solves(spark, rng):
    rows, rhs, want = [], [], {}
    for b in range(3):
        m = rng.normal(size=(3, 3))
        m, y = m @ m.T + np.eye(3), rng.normal(size=3)
        rows += [(b, i, j, float(m[i, j])) for i in range(3) for j in range(3)]
        rhs += [(b, i, float(y[i])) for i in range(3)]
        want |= {(b, i): x for i, x in enumerate(np.linalg.solve(m, y))}
    out = solvers.batched_conjugate_gradient(spark.createDataFrame(rows, "k int, row int, col int, v double"), spark.createDataFrame(rhs, "k int, i int, b double"), "k", 4, 1e-12)
    assert all(math.isclose(r.x, want[r.k, r.i], rel_tol=1e-6) for r in out.collect())


def test_transforms_in_two_dimensions(spark, rng):
    z = rng.normal(size=(4, 6)) + 1j * rng.normal(size=(4, 6))
    df = spark.createDataFrame([(y, x, float(z[y, x].real), float(z[y, x].imag)) for y in range(4) for x in range(6)], "y int, x int, re double, im double")
    f = transforms.fft_nd(spark, {"y": 4, "x": 6}, centred=False)
    assert np.allclose(array(f(df), "y", "x").reshape(4, 6), np.fft.fft2(z, norm="ortho"))
    assert np.allclose(array(f.N(df), "y", "x").reshape(4, 6), z)


def test_windowed_transform_has_its_adjoint(spark, rng):
    z, y = (rng.normal(size=n) + 1j * rng.normal(size=n) for n in (16, 10))
    coords = spark.createDataFrame([(s, float(k)) for s, k in enumerate(rng.uniform(-7, 7, 10))], "s int, kx double")
    modes = vector(spark, z).withColumnRenamed("i", "x")
    forward = array(transforms.kb_nufft(modes, coords, 16), "s")
    back = array(transforms.kb_nufft_adjoint(coords.join(vector(spark, y).withColumnRenamed("i", "s"), "s"), 16), "x")
    assert np.isclose(np.vdot(forward, y), np.vdot(z, back))


def test_map_estimation_explains_the_samples(spark, rng):
    n, coils = 8, 2
    image = spark.createDataFrame([(i - 4, float(v), 0.5) for i, v in enumerate(rng.uniform(1, 2, n))], "n int, re double, im double")
    maps = spark.createDataFrame([(c, i - 4, float(rng.normal()), float(rng.normal())) for c in range(coils) for i in range(n)], "coil int, n int, sre double, sim double")
    freqs = spark.createDataFrame([(s, -math.pi + 2 * math.pi * s / 24) for s in range(24)], "s int, kn double")
    samples = sense.forward(image, maps, freqs, {"n": n}).join(freqs, "s")
    found = sense.estimate_maps(samples, image, freqs, {"n": n}, 12, 1e-6)
    want = {(r.coil, r.n): complex(r.sre, r.sim) for r in maps.collect()}
    assert all(abs(complex(r.sre, r.sim) - want[r.coil, r.n]) < 1e-3 for r in found.collect())


def test_normal_matrix_is_the_normal_operator(spark, rng):
    n, maps = 6, spark.createDataFrame([(c, i - 3, float(rng.normal()), float(rng.normal())) for c in range(2) for i in range(6)], "coil int, n int, sre double, sim double")
    freqs = spark.createDataFrame([(f, s, float(rng.uniform(-3, 3))) for f in range(2) for s in range(5 + f)], "frame int, s int, kn double")
    image = spark.createDataFrame([(f, i - 3, float(rng.normal()), float(rng.normal())) for f in range(2) for i in range(n)], "frame int, n int, re double, im double")
    x = {(r.frame, r.n): complex(r.re, r.im) for r in image.collect()}
    got = dict.fromkeys(x, 0)
    for r in sense.normal_matrix(maps, freqs, n).collect():
        got[r.frame, r.n] += complex(r.mre, r.mim) * x[r.frame, r.m]
    want = {(r.frame, r.n): complex(r.re, r.im) for r in sense.normal(image, maps, freqs, {"n": n}).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_block_thresholds_take_every_frame(spark, sf_dir):
    def rows(df):
        return array(df, "frame", "y", "x").reshape(-1, 4, 8)

    whole = rows(iterative._frames(spark, sf_dir))
    assert len(whole) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    for query, amount, soft in ((iterative.svt_soft_blocks, 0.1, True), (iterative.svt_hard_blocks, 2.0, False)):
        got = rows(query(spark, sf_dir))
        for x in (0, 4):
            want = blocks.threshold(whole[:, :, x : x + 4].reshape(len(whole), 16), amount, soft)
            assert np.allclose(got[:, :, x : x + 4].reshape(len(whole), 16), want, atol=1e-4)
    got = rows(iterative.svt_random_blocks(spark, sf_dir))
    want = whole.copy()
    for _, y, x in sorted(map(tuple, blocks.random_corners(spark, 10, 3, ("y", "x"), (4, 8), seed=3).collect())):
        want[:, y : y + 3, x : x + 3] = blocks.threshold(want[:, y : y + 3, x : x + 3].reshape(len(whole), 9), 0.1, True).reshape(-1, 3, 3)
    assert np.allclose(got, want, atol=1e-4)


def test_values_that_are_not_finite_raise(spark):
    t = Tensor(spark.createDataFrame([(0, 1.0), (1, float("inf"))], "i int, re double"), ("i",))
    with pytest.raises(Exception, match="not finite"):
        t.require_finite().df.collect()


def test_surface_and_largest(spark):
    df = spark.createDataFrame([(1, 2.0)], "k int, t double")
    got = sorted(map(tuple, fitting.objective_surface(df, lambda a, b: (a - F.col("t")) ** 2 + b, {"a": [1, 2], "b": [0, 3]}, "k").collect()))
    assert got == [(1, 1.0, 0.0, 1.0), (1, 1.0, 3.0, 4.0), (1, 2.0, 0.0, 0.0), (1, 2.0, 3.0, 3.0)]
    cut = selection.crop_samples_to_largest(spark.createDataFrame([(1.0, 0.5, 0.0), (9.0, 0.0, 0.0)], "kx double, ky double, kz double"), (4.0, 4.0, 4.0))
    assert [(r.kx, r.ky) for r in cut.collect()] == [(math.pi, math.pi / 2)]
