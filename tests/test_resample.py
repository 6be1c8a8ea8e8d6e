"""New samples of velocity images, beside plain sums in numpy."""

import math

import numpy as np

from tensorloom.operators import resample
from tensorloom.operators.velocity import DIRECTIONS
from tensorloom.plans import reconstruction

IMAGES = "frame int, x int, y int, mag double, vx double, vy double, vz double"


def test_full_resampling_equals_the_direct_sum(spark, sf_dir):
    images, maps, coords = reconstruction.resampling_inputs(spark, sf_dir)
    frames = {}
    for r in images.collect():
        frames.setdefault(r["frame"], np.zeros((4, 4, 4)))[:, r["x"], r["y"]] = [r[c] for c in resample.CHANNELS]
    series = {2 * f: v for f, v in frames.items()} | {2 * f + 1: (frames[f] + frames[f + 1]) / 2 for f in frames if f + 1 in frames}
    coil = np.zeros((2, 4, 4), complex)
    for r in maps.collect():
        coil[r["coil"], r["x"], r["y"]] = complex(r["re"], r["im"])
    k = math.pi / (0.5 * math.sqrt(3))
    centred = np.arange(4) - 2
    want = {}
    for r in coords.collect():
        if r["frame"] not in series:
            continue
        mag, v = series[r["frame"]][0], series[r["frame"]][1:]
        image = mag * np.exp(1j * k * np.tensordot(DIRECTIONS[r["enc"]], v, 1))
        turn = np.exp(-2j * np.pi / 4 * (r["kx"] * centred[:, None] + r["ky"] * centred[None, :]))
        for c in range(2):
            want[r["frame"], c, r["enc"], r["spoke"], r["s"], r["kx"], r["ky"]] = (image * coil[c] * turn).sum() / 4
    out = resample.full_resampling(images, maps, coords, reconstruction.SLICE, 0.5, between=1).collect()
    got = {tuple(r)[:7]: complex(r["re"], r["im"]) for r in out}
    assert len(out) == len(got) and got.keys() == want.keys() and len(series) == 19
    a, b = (np.array([d[key] for key in sorted(want)]) for d in (got, want))
    assert np.linalg.norm(a - b) < 1e-3 * np.linalg.norm(b)


def test_frames_between_leave_out_what_has_no_neighbour(spark):
    images = spark.createDataFrame([(f, 0, 0, float(f), 1.0, 2.0, 3.0) for f in (0, 1, 3)], IMAGES)
    got = sorted((r["frame"], r["mag"], r["vz"]) for r in resample.frames_between(images, 1, "x", "y").collect())
    assert got == [(0, 0.0, 3.0), (1, 0.5, 3.0), (2, 1.0, 3.0), (6, 3.0, 3.0)]
    assert sorted(r["frame"] for r in resample.frames_between(images, 0, "x", "y").collect()) == [0, 1, 3]
    assert resample.frames_between(images.limit(0), 2, "x", "y").count() == 0


def test_crop_nulls_and_empty_tables(spark):
    images = spark.createDataFrame([(0, x, y, 1.0, None if x == y == 2 else 0.0, 0.0, 0.0) for x in range(4) for y in range(4)], IMAGES)
    maps = spark.createDataFrame([(0, x, y, 1.0, 0.0) for x in range(4) for y in range(4)], "coil int, x int, y int, re double, im double")
    coords = spark.createDataFrame([(0, 0, 0, 0, 0.0, 0.0), (5, 0, 1, 0, 0.0, 0.0)], "frame int, enc int, spoke int, s int, kx double, ky double")
    coords = coords.union(coords)
    box = {"x": 2, "y": 2}
    rows = resample.full_resampling(images, maps, coords, box, 1.0, corner={"x": 1, "y": 1}).collect()
    assert len(rows) == 1 and abs(rows[0]["re"] - 3 / 2) < 1e-3  # three of four voxels are known; the other sample has no image
    assert resample.full_resampling(images.limit(0), maps, coords, box, 1.0).count() == 0
