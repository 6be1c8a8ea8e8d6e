import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import precondition, sense, solvers, transforms, volumes
from tensorloom.operators.prox import scaled
from tensorloom.plans import linear

SIZES = {"x": 6, "y": 4, "z": 3}


def _cells(sizes):
    return np.stack(np.meshgrid(*[np.arange(-(n // 2), n - n // 2) for n in sizes.values()], indexing="ij"), -1).reshape(-1, len(sizes))


def _problem(spark, sizes=SIZES, coils=3, samples=400, seed=0, narrow=1.0):
    """(maps as rows, frequencies as rows, maps, coordinates)."""
    rng = np.random.default_rng(seed)
    at = _cells(sizes)
    s = rng.normal(size=(coils, len(at))) + 1j * rng.normal(size=(coils, len(at)))
    k = np.sign(rng.uniform(-1, 1, (samples, len(sizes)))) * np.pi * rng.uniform(0, 1, (samples, len(sizes))) ** narrow
    axes = list(sizes)
    maps = spark.createDataFrame([(c, *map(int, p), float(s[c, i].real), float(s[c, i].imag)) for c in range(coils) for i, p in enumerate(at)], f"coil int, {', '.join(a + ' int' for a in axes)}, sre double, sim double")
    freqs = spark.createDataFrame([(i, *map(float, q), float(1 + i % 3)) for i, q in enumerate(k)], f"s int, {', '.join('k' + a + ' double' for a in axes)}, w double")
    return maps, freqs, s, k


def _matrix(s, k, sizes, w=None):
    """All samples of all coils as rows: A."""
    e = np.exp(-1j * k @ _cells(sizes).T)
    return np.concatenate([e * c for c in s])


def _kspace(s, k, sizes, w):
    """|sum_n s_i conj(s_j) e^(i (k' - k) n)|^2, all pairs of samples written out."""
    e = np.exp(1j * k @ _cells(sizes).T)
    out = np.zeros((len(s), len(k)))
    for i, a in enumerate(s):
        for b in s:
            out[i] += (np.abs((np.conj(e) * (a * np.conj(b))) @ e.T) ** 2 * w).sum(1)
    return (np.abs(s) ** 2).sum(1)[:, None] / out


@pytest.mark.parametrize("sizes", [{"x": 9}, {"x": 6, "y": 5}, SIZES])
def test_kspace_weights_are_the_sums_over_pairs_of_samples(spark, sizes):
    maps, freqs, s, k = _problem(spark, sizes)
    got = precondition.kspace_weights(maps, freqs.select("s", *[f"k{a}" for a in sizes], "w"), sizes, weight=F.col("w")).toPandas()
    p = np.zeros((len(s), len(k)))
    p[got["coil"], got["s"]] = got["p"]
    assert len(got) == p.size
    assert np.abs(p / _kspace(s, k, sizes, 1 + np.arange(len(k)) % 3) - 1).max() < 2e-3


@pytest.mark.parametrize("sizes", [{"x": 9}, {"x": 6, "y": 5}, SIZES])
def test_circulant_weights_are_the_diagonal(spark, sizes):
    maps, freqs, s, k = _problem(spark, sizes)
    got = precondition.circulant_weights(maps, freqs, sizes).toPandas()
    a = _matrix(s, k, sizes)
    shape = tuple(sizes.values())
    there = np.fft.fftn(np.eye(a.shape[1]).reshape(-1, *shape), axes=range(1, 1 + len(shape)), norm="ortho").reshape(a.shape[1], -1).T
    want = 1 / np.einsum("in,nm,im->i", there, a.conj().T @ a, there.conj()).real.reshape(shape)
    out = np.zeros(shape)
    out[tuple(got[c].to_numpy() for c in sizes)] = got["mre"]
    assert len(got) == want.size and not got["mim"].any()
    assert np.abs(out / want - 1).max() < 2e-3


def test_one_axis_equals_the_sums(spark):
    maps, freqs, _, _ = _problem(spark, {"n": 12})
    plain = {r.i: r.mre for r in sense.circulant_build(maps, freqs.select("s", "kn"), 12).collect()}
    assert {r.n: pytest.approx(r.mre, rel=1e-3) for r in precondition.circulant_weights(maps, freqs, {"n": 12}).collect()} == plain
    plain = {(r.coil, r.s): r.p for r in sense.kspace_preconditioner(maps, freqs.select("s", "kn"), 12).collect()}
    got = {(r.coil, r.s): r.p for r in precondition.kspace_weights(maps, freqs, {"n": 12}).collect()}
    assert got.keys() == plain.keys() and all(got[x] == pytest.approx(plain[x], rel=1e-3) for x in plain)


def test_blocks_of_few_planes_give_the_same(spark, monkeypatch):
    maps, freqs, _, _ = _problem(spark)
    rows = lambda df: {tuple(r[:-1]): r[-1] for r in df.collect()}
    build = lambda: rows(precondition.circulant_weights(maps, freqs, SIZES).drop("mim"))
    weigh = lambda: rows(precondition.kspace_weights(maps, freqs, SIZES))
    whole, seen = build(), weigh()
    monkeypatch.setattr(volumes, "BLOCK_CELLS", 100)
    assert volumes.thickness({a: 2 * n for a, n in SIZES.items()}) == (2, 1)
    for one, other in ((whole, build()), (seen, weigh())):
        assert one.keys() == other.keys() and all(other[c] == pytest.approx(one[c], rel=1e-9) for c in one)


def test_awkward_tables(spark):
    maps, freqs, _, _ = _problem(spark, samples=20)
    assert precondition.kspace_weights(maps.limit(0), freqs, SIZES).count() == 0
    assert precondition.circulant_weights(maps.limit(0), freqs, SIZES).count() == 0
    zero = maps.withColumns({"sre": F.lit(0.0), "sim": F.lit(0.0)})
    assert {r.mre for r in precondition.circulant_weights(zero, freqs, SIZES).select("mre").distinct().collect()} == {1.0}
    assert {r.p for r in precondition.kspace_weights(zero, freqs, SIZES).select("p").distinct().collect()} == {1.0}
    holed = freqs.withColumn("kx", F.when(F.col("s") != 3, F.col("kx")))
    assert precondition.kspace_weights(maps, holed, SIZES).where("s = 3").count() == 0


def test_conjugate_gradients_need_fewer_rounds(spark):
    """Samples that crowd at the centre; 1-norm smooth maps. The error after four rounds with is below that of four without."""
    sizes = {"x": 6, "y": 6, "z": 2}
    _, freqs, _, k = _problem(spark, sizes, samples=900, narrow=2.5)
    at = _cells(sizes)
    s = np.exp(1j * np.stack([0.2 * at[:, 0], -0.1 * at[:, 1]])) * (1 + 0.1 * np.stack([at[:, 0], at[:, 1]]))
    maps = spark.createDataFrame([(c, *map(int, p), float(s[c, i].real), float(s[c, i].imag)) for c in range(2) for i, p in enumerate(at)], "coil int, x int, y int, z int, sre double, sim double")
    truth = np.random.default_rng(1).normal(size=len(at)) + 0j
    a = _matrix(s, k, sizes)
    right = a.conj().T @ (a @ truth)
    b = spark.createDataFrame([(*map(int, p), float(v.real), float(v.imag)) for p, v in zip(at, right, strict=True)], "x int, y int, z int, re double, im double")
    spectrum = transforms.toeplitz_blocks(transforms.toeplitz_spectrum(freqs.select("s", "kx", "ky", "kz"), sizes), sizes).cache()
    weights = precondition.circulant_blocks(precondition.circulant_weights(maps, freqs, sizes), sizes).cache()

    def error(**more):
        x = solvers.conjugate_gradient(lambda v: sense.toeplitz_normal(v, maps, spectrum, sizes), b, scaled(b, 0.0), 4, **more).toPandas().sort_values(["x", "y", "z"])
        return np.linalg.norm(x["re"] + 1j * x["im"] - truth) / np.linalg.norm(truth)

    without, with_it = error(), error(precondition=lambda r: precondition.circulant_apply(r, weights, sizes))
    assert with_it < 0.6 * without


def _tables(spark, sf_dir):
    """(maps: coils x cells, coordinates, vectors: ids x cells) of the queries in three dimensions, by numpy."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    z = np.stack(vectors["embedding"].to_numpy()).astype(float)
    z = z[:, ::2] + 1j * z[:, 1::2]
    labels = np.sort(vectors["label"].unique())
    maps = np.stack([z[vectors["label"] == c].mean(0) for c in labels])
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").toPandas()
    k = np.stack([(items["l_quantity"].astype(float) - 25) / 25, items["l_discount"].astype(float) * 10 - 0.5, items["l_tax"].astype(float) * 12 - 0.5], 1) * np.pi
    return labels, maps, (items["l_orderkey"] * 8 + items["l_linenumber"]).to_numpy(), k, vectors["vec_id"].to_numpy(), z


def test_queries_in_three_dimensions(spark, sf_dir):
    labels, s, ids, k, vec_ids, images = _tables(spark, sf_dir)
    sizes = linear.BOX
    points, which = np.unique(k, axis=0, return_inverse=True)
    count = np.bincount(which.ravel())
    e = np.exp(-1j * points @ _cells(sizes).T)
    toeplitz = e.conj().T @ (e * count[:, None])
    a = (s.conj().T @ s) * toeplitz

    got = linear.sense_grid_normal(spark, sf_dir).toPandas().sort_values(["vec_id", *sizes])
    got = (got["re"] + 1j * got["im"]).to_numpy().reshape(len(vec_ids), -1)
    want = images @ a.T
    assert np.linalg.norm(got - want) < 1e-3 * np.linalg.norm(want)

    shape = tuple(sizes.values())
    there = np.fft.fftn(np.eye(a.shape[1]).reshape(-1, *shape), axes=(1, 2, 3), norm="ortho").reshape(a.shape[1], -1).T
    diagonal = np.einsum("in,nm,im->i", there, a, there.conj()).real
    got = linear.circulant_weights_3d(spark, sf_dir).toPandas().sort_values(list(sizes))
    assert np.abs(got["v"].to_numpy() * 1e-4 * diagonal - 1).max() < 1e-3

    weights = _kspace(s, points, sizes, count)
    got = linear.kspace_weights_3d(spark, sf_dir).toPandas()
    want = {(int(c), int(i)): [] for c in labels for i in ids}
    for i, row in {(int(i), int(w)) for i, w in zip(ids, which.ravel(), strict=True)}:
        for c, label in enumerate(labels):
            want[int(label), i].append(weights[c, row])
    found = {key: [] for key in want}
    for r in got.itertuples():
        found[r.coil, r.s].append(r.v * 1e-6)
    assert all(np.allclose(sorted(found[key]), sorted(want[key]), rtol=2e-3, atol=0) for key in want)


def test_nothing_that_grows_is_broadcast(spark, sf_dir):
    plan = linear.kspace_weights_3d(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_grids_meet_samples_in_several_groups(spark, monkeypatch):
    maps, freqs, _, _ = _problem(spark, samples=120)
    weigh = lambda: {(r.coil, r.s): r.p for r in precondition.kspace_weights(maps, freqs, SIZES).collect()}
    monkeypatch.setattr(volumes, "WHOLE_CELLS", 1 << 14)
    one = weigh()
    monkeypatch.setattr(volumes, "TILE_SAMPLES", 7)
    several = weigh()
    monkeypatch.setattr(volumes, "WHOLE_CELLS", 0)
    tiles = weigh()
    assert len(one) == 360 and one.keys() == several.keys() == tiles.keys()
    assert all(several[x] == pytest.approx(one[x], rel=1e-9) and tiles[x] == pytest.approx(one[x], rel=1e-9) for x in one)
