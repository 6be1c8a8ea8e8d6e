"""Direct sums by arrays beside numpy: batches, split batches, several blocks of modes, repeated keys; and what their plans list."""

import numpy as np
import pytest

from tensorloom.operators import direct, sense, transforms


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


@pytest.fixture
def problem(spark):
    rng = np.random.default_rng(3)
    x, k = rng.normal(size=(2, 3, 6, 2)), rng.uniform(-np.pi, np.pi, 40)
    modes = [(b, c, int(n), *map(float, x[b, c, n + 3])) for b in range(2) for c in range(3) for n in range(-3, 3)]
    freqs = [(s % 2, s, float(k[s])) for s in range(40)]
    return spark.createDataFrame(modes, "b int, coil int, n int, re double, im double"), spark.createDataFrame(freqs, "b int, s long, kn double"), x[..., 0] + 1j * x[..., 1], k


@pytest.mark.parametrize("chunk, block", [(1 << 13, 1 << 12), (3, 1 << 12), (1 << 13, 4)])
def test_both_types_and_the_normal_operator(spark, monkeypatch, problem, chunk, block):
    monkeypatch.setattr(direct, "CHUNK", chunk)
    monkeypatch.setattr(direct, "MODES", block)
    modes, freqs, x, k = problem
    wave = np.exp(1j * np.outer(k, np.arange(-3, 3)))
    there = {(r.b, r.coil, r.s): complex(r.re, r.im) for r in transforms.nufft2(modes, freqs, {"n": 6}).collect()}
    want = {(s % 2, c, s): wave[s].conj() @ x[s % 2, c] for s in range(40) for c in range(3)}
    assert there.keys() == want.keys() and max(abs(there[i] - want[i]) for i in want) < 1e-12
    back = {(r.b, r.coil, r.n): complex(r.re, r.im) for r in transforms.nufft_normal(modes, freqs, {"n": 6}).collect()}
    for b in range(2):
        for c in range(3):
            values = wave[b::2].T @ (wave[b::2].conj() @ x[b, c])
            assert max(abs(back[b, c, n] - values[n + 3]) for n in range(-3, 3)) < 1e-11


def test_rows_of_one_key_are_summed_and_null_coordinates_give_null(spark, problem):
    modes, _, x, _ = problem
    freqs = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.5), (0, 2, None)], "b int, s long, kn double")
    got = {(r.coil, r.s): r.re for r in transforms.nufft2(modes, freqs, {"n": 6}).collect()}
    want = 2 * np.exp(-0.5j * np.arange(-3, 3)) @ x[0, 1]
    assert abs(got[1, 1] - want.real) < 1e-12 and got[1, 2] is None and len(got) == 6


def test_samples_without_a_coil_are_those_of_every_coil(spark, problem):
    modes, freqs, _, _ = problem
    maps = modes.where("b = 0").select("coil", "n", "re", "im").withColumnsRenamed({"re": "sre", "im": "sim"})
    own = freqs.selectExpr("b", "s", "kn", "cos(s) AS re", "sin(s) AS im")
    every = own.join(maps.select("coil").distinct().hint("broadcast"))
    one, other = ({(r.b, r.n): complex(r.re, r.im) for r in sense.adjoint(y, maps, {"n": 6}).collect()} for y in (own, every))
    assert one.keys() == other.keys() and max(abs(one[i] - other[i]) for i in one) < 1e-12


def test_no_mode_is_listed_for_each_sample(spark, problem):
    modes, freqs, _, _ = problem
    maps = modes.where("b = 0").select("coil", "n", "re", "im").withColumnsRenamed({"re": "sre", "im": "sim"})
    image = modes.where("coil = 0").drop("coil")
    normal = sense.normal(image, maps, freqs, {"n": 6}, between=sense.residual(freqs.selectExpr("s", "kn AS re", "kn AS im"), None, "s"))
    for df in (transforms.nufft2(modes, freqs, {"n": 6}), transforms.nufft_normal(modes, freqs, {"n": 6}), normal, transforms.toeplitz_kernel(freqs, 6, batch=("b",))):
        assert "sequence(-" not in _plan(df)


@pytest.mark.parametrize("nodes", [32, 1 << 20])
def test_sums_at_any_frequency_with_and_without_fewer_points(spark, monkeypatch, nodes):
    if nodes > 32:
        monkeypatch.setattr(transforms, "condensed", None)
        monkeypatch.setattr(transforms, "TURN", 1e-9)
    rng = np.random.default_rng(5)
    p, z, w = rng.uniform(-3, 9, 4000), rng.normal(size=(4000, 2)), rng.uniform(-4, 5, 30)
    p[:3] = 0.0
    points = spark.createDataFrame([(float(a), float(b), float(c)) for a, (b, c) in zip(p, z, strict=True)], "p double, re double, im double")
    targets = spark.createDataFrame([(t, float(v)) for t, v in enumerate(w)], "t long, w double")
    got = {r.t: complex(r.re, r.im) for r in transforms.direct_dft(points, targets, blocks=3).collect()}
    want = np.exp(1j * np.outer(w, p)) @ (z[:, 0] + 1j * z[:, 1])
    assert max(abs(got[t] - want[t]) for t in range(30)) < 1e-10 * np.abs(z).sum()


def test_targets_of_a_direct_sum_do_not_go_to_a_block_of_few_points_each(spark):
    points = spark.range(200000).selectExpr("id / 100000.0D AS p", "1.0D AS re", "0.0D AS im")
    plan = _plan(transforms.direct_dft(points, spark.range(5).selectExpr("id AS t", "id * 1.0D AS w")))
    assert "sequence(0, 0," in plan and "sequence(0, 48," not in plan


def test_all_volumes_do_not_meet_their_kernel_in_one_task(spark):
    sizes = {"x": 4, "y": 4, "z": 2}
    cells = spark.range(320).selectExpr("id % 10 AS v", "CAST(id / 10 AS INT) % 4 - 2 AS x", "CAST(id / 40 AS INT) % 4 - 2 AS y", "CAST(id / 160 AS INT) - 1 AS z", "1.0D * id AS re", "0.0D AS im")
    spectrum = spark.range(256).selectExpr("CAST(id / 32 AS INT) AS x", "CAST(id / 4 AS INT) % 8 AS y", "CAST(id % 4 AS INT) AS z", "2.0D AS mre", "0.0D AS mim")
    got = transforms.toeplitz_apply(cells, spectrum, sizes)
    assert "strategy=broadcast" in _plan(got)
    want = {(r.v, r.x, r.y, r.z): 2 * r.re for r in cells.collect()}
    have = {(r.v, r.x, r.y, r.z): r.re for r in got.collect()}
    assert have.keys() == want.keys() and max(abs(have[i] - want[i]) for i in want) < 1e-9
