"""R factors by a tree beside numpy."""

import numpy as np
import pytest

from tensorloom.operators import blocks
from tensorloom.plans import iterative


def cube(spark, ms):
    rows = [(b, i, j, float(m[i, j].real), float(m[i, j].imag)) for b, m in ms.items() for i, j in np.ndindex(m.shape)]
    return spark.createDataFrame(rows, "block int, row int, col int, re double, im double").repartition(5)


def conditioned(rng, n, m, condition):
    u, _ = np.linalg.qr(rng.normal(size=(n, m)) + 1j * rng.normal(size=(n, m)))
    v, _ = np.linalg.qr(rng.normal(size=(m, m)) + 1j * rng.normal(size=(m, m)))
    return (u * np.logspace(0, -np.log10(condition), m)) @ v


@pytest.mark.parametrize("cells", [1 << 18, 300])
def test_singular_values_of_ill_conditioned_matrices(spark, monkeypatch, cells):
    """In one part, and in many parts merged in several steps; also a block with fewer rows than columns."""
    monkeypatch.setattr(blocks, "QR_CELLS", cells)
    monkeypatch.setattr(blocks, "QR_FAN", 3)
    rng = np.random.default_rng(0)
    ms = {0: conditioned(rng, 600, 9, 1e6), 1: conditioned(rng, 40, 9, 10), 2: rng.normal(size=(4, 9)) + 0j}
    got = {}
    for r in blocks.singular_values(cube(spark, ms), "block", ["row"]).collect():
        got.setdefault(r["block"], {})[r["rank"]] = r["s"]
    for b, m in ms.items():
        want = np.linalg.svd(m, compute_uv=False)
        assert len(got[b]) == len(want) and np.allclose([got[b][k] for k in range(len(want))], want, rtol=1e-9, atol=1e-13)


@pytest.mark.parametrize("soft, amount", [(True, 1e-4), (False, 4.0)])
def test_tall_threshold_equals_numpy(spark, monkeypatch, soft, amount):
    monkeypatch.setattr(blocks, "QR_CELLS", 200)
    m = conditioned(np.random.default_rng(1), 120, 6, 1e6)
    table = cube(spark, {0: m}).drop("block").withColumnsRenamed({"row": "frame", "col": "x"})
    done = blocks.svt_pass(table, ("x",), ["frame"], 6, 6, (0,), (7,), amount, soft, tall=True)
    got = np.zeros_like(m)
    for r in done.collect():
        got[r["frame"], r["x"]] = complex(r["re"], r["im"])
    assert np.allclose(got, blocks.threshold(m, amount, soft), atol=1e-10)


def test_query_splits_a_label(spark, sf_dir, monkeypatch):
    want = {r["rank"]: r for r in iterative.svd_order_stats(spark, sf_dir).collect()}
    monkeypatch.setattr(blocks, "QR_CELLS", 500)
    got = {r["rank"]: r for r in iterative.svd_order_stats(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][c] - want[k][c]) < 1e-3 for k in want for c in want[k].asDict() if c != "rank")
    assert blocks.singular_values(spark.createDataFrame([], "b int, i int, j int, re double, im double"), "b", ["i"]).count() == 0


def plain_rounds(corners, size):
    out = {}
    for k, at in corners:
        before = [out[j] for j, other in corners if j < k and all(abs(a - b) < size for a, b in zip(at, other, strict=True))]
        out[k] = 1 + max(before) if before else 0
    return out


def test_rounds_keep_the_order_of_overlapping_blocks(spark):
    corners = blocks.random_corners(spark, 1500, 4, ("x", "y", "z"), (40, 40, 40), seed=1)
    rows = sorted((r[0], tuple(r)[1:]) for r in corners.collect())
    got = {r["_block"]: r["_round"] for r in blocks.in_rounds(corners, ("x", "y", "z"), 4).collect()}
    assert got == plain_rounds(rows, 4) and max(got.values()) > 3
    assert blocks.in_rounds(corners.limit(0), ("x", "y", "z"), 4).count() == 0


def test_overlapping_blocks_equal_the_loop(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3, 30, 20)) + 1j * rng.normal(size=(3, 30, 20))
    cells = [(f, y, x, float(v[f, y, x].real), float(v[f, y, x].imag)) for f, y, x in np.ndindex(v.shape)]
    table = spark.createDataFrame(cells, "frame int, y int, x int, re double, im double")
    corners = blocks.random_corners(spark, 60, 4, ("y", "x"), (30, 20), seed=4)
    for _, y, x in sorted(map(tuple, corners.collect())):
        cut = (slice(None), slice(y, y + 4), slice(x, x + 4))
        v[cut] = blocks.threshold(v[cut].reshape(3, 16), 0.3, True).reshape(3, 4, 4)
    got = np.zeros_like(v)
    for r in blocks.svt_at(table, ("y", "x"), ["frame"], corners, 4, 0.3).collect():
        got[r["frame"], r["y"], r["x"]] = complex(r["re"], r["im"])
    assert np.allclose(got, v)
