import math

import numpy as np
import pytest

from tensorloom.sources import generators, readers, writers


def test_import_refuses_other_types(spark, tmp_path):
    spark.createDataFrame([(0, "a")], "i int, re string").write.parquet(str(tmp_path / "t"))
    with pytest.raises(TypeError):
        readers.import_tensor(spark, str(tmp_path / "t"))


def test_round_trip_by_frame_and_encode(spark, tmp_path):
    cube = spark.createDataFrame([(f, e, i, float(i), 0.0) for f in range(2) for e in range(3) for i in range(4)], "frame int, enc int, i int, re double, im double")
    writers.write_image(cube, str(tmp_path / "cube"))
    back = readers.import_tensor(spark, str(tmp_path / "cube"))
    assert sorted(map(tuple, back.select(*cube.columns).collect())) == sorted(map(tuple, cube.collect()))
    writers.write_curve([1.0, 0.5], spark, str(tmp_path / "curve"))
    assert spark.read.parquet(str(tmp_path / "curve")).count() == 2


def test_keyed_files(spark, tmp_path):
    for f in range(2):
        spark.range(3).write.parquet(str(tmp_path / f"k_f{f}_e1.parquet"))
    keyed = readers.load_keyed(spark, str(tmp_path))
    assert readers.frame_counts(keyed).first().asDict() == {"frames": 2, "encodes": 1}


def test_raw_projection(spark, tmp_path):
    row = "enc int, coil int, spoke int, s int, kx double, ky double, kz double, w double, re double, im double, ecg double"
    spark.createDataFrame([(0, 0, 0, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 5.0)], row).write.parquet(str(tmp_path / "raw"))
    got = readers.load_raw(spark, str(tmp_path / "raw"), coords=False, weights=False, gating=("ecg",))
    assert got.columns == ["enc", "coil", "spoke", "s", "re", "im", "ecg"]


def test_generators(spark):
    assert generators.ones(spark, (2, 3)).sum().first()[0] == 6
    assert generators.zeros(spark, (2, 3)).numel().first()[0] == 6
    a, b = (sorted(map(tuple, generators.rand(spark, (4, 4), seed=1).df.collect())) for _ in range(2))
    assert a == b and 0 <= min(r[-1] for r in a) and max(r[-1] for r in a) < 1
    assert generators.spokes(spark, 5, 8).count() > 20
    assert generators.cartesian(spark, (4, 4, 4), keep=0.25).count() == 16
    assert generators.mid_random(spark, 10).where("abs(kx) <= 3.1416").count() == 10


def test_maps_with_zoom(spark, tmp_path):
    spark.createDataFrame([(c, i, float(i), 1.0) for c in range(2) for i in range(3)], "coil int, x int, re double, im double").write.parquet(str(tmp_path / "maps"))
    got = sorted(map(tuple, readers.load_maps(spark, str(tmp_path / "maps"), {"x": (3, 5)}).where("coil = 0").select("x", "re", "im").collect()))
    assert got == [(i, i / 2, 1.0) for i in range(5)]


def test_vipr_spokes_against_rotations(spark):
    angles = generators.random_angles(spark, 6, seed=3)
    turned = {r["spoke"]: (r["xangle"], r["zangle"]) for r in angles.collect()}
    got = generators.vipr_spokes(angles, 9, noise=0.0).collect()
    assert len(got) == 54
    for r in got:
        a, b = turned[r["spoke"]]
        rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
        rz = np.array([[math.cos(b), -math.sin(b), 0], [math.sin(b), math.cos(b), 0], [0, 0, 1]])
        line = np.array([0, 0, math.pi * np.linspace(-1 / 3, 1, 9)[r["s"]]])
        assert np.allclose([r["kx"], r["ky"], r["kz"]], rz @ rx @ line, atol=1e-12)


def test_vipr_noise_crop_and_null_angles(spark):
    angles = generators.random_angles(spark, 200, seed=1)
    plain, shaken = (generators.vipr_spokes(angles, 4, noise=n).toPandas().sort_values(["spoke", "s"]) for n in (0.0, 0.05))
    off = (shaken[["kx", "ky", "kz"]].to_numpy() - plain[["kx", "ky", "kz"]].to_numpy()).ravel()
    assert abs(off.mean()) < 0.005 and abs(off.std() - 0.05) < 0.005
    cut = generators.vipr_spokes(angles, 4, noise=0.0, crop=1.5)
    assert 0 < cut.count() < 800 and cut.where("abs(kx) >= pi() or abs(ky) >= pi() or abs(kz) >= pi()").count() == 0
    none = spark.createDataFrame([(0, None, 1.0)], "spoke long, xangle double, zangle double")
    assert generators.vipr_spokes(none, 4).where("kz is null").count() == 4
    assert generators.vipr_spokes(none, 4, crop=2.0).count() == 0
