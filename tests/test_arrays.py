"""Array files by frame and encode: what is read, and what is not even opened."""

import numpy as np
import pytest

from tensorloom.sources.arrays import load_arrays

AXES, COILS = 3, 2


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(4)
    data = {}
    for f in range(3):
        for e in range(2):
            n = 40 + 7 * f + e
            arrays = {"coords": rng.normal(size=(AXES, n)), "kdata": (rng.normal(size=(COILS, n)) + 1j * rng.normal(size=(COILS, n))).astype(np.complex64), "weights": rng.random(n).astype(np.float32)}
            (tmp_path / f"scan{f}").mkdir(exist_ok=True)
            for q, a in arrays.items():
                np.save(tmp_path / f"scan{f}" / f"{q}_f{f}_e{e}.npy", np.asfortranarray(a) if e else a)
            data[f, e] = arrays
    (tmp_path / "notes.txt").write_text("not an array")
    return tmp_path, data


def expected(data):
    return sorted((f, e, s, c, *(float(x) for x in a["coords"][:, s]), float(a["kdata"][c, s].real), float(a["kdata"][c, s].imag), float(a["weights"][s])) for (f, e), a in data.items() for s in range(a["weights"].size) for c in range(COILS))


COLUMNS = ["frame", "enc", "s", "coil", "kx", "ky", "kz", "re", "im", "w"]


def test_whole_folder_in_any_number_of_parts(spark, folder):
    path, data = folder
    for size in (64 << 20, 500):
        df = load_arrays(spark, str(path), part_bytes=size)
        assert sorted(map(tuple, df.select(*COLUMNS).collect())) == expected(data)
        assert (df.rdd.getNumPartitions() > 6) == (size == 500)
    assert load_arrays(spark, path.as_uri()).count() == len(expected(data))


def test_only_the_asked_files_are_opened(spark, folder):
    path, data = folder
    for f, e in data:  # any other file would be an error
        for q in data[f, e]:
            if (f, e) != (1, 1):
                (path / f"scan{f}" / f"{q}_f{f}_e{e}.npy").write_bytes(b"broken")
    df = load_arrays(spark, str(path))
    asked = df.where("frame = 1 and enc >= 1 and enc < 5 and coil in (1)")
    got = sorted(map(tuple, asked.select(*COLUMNS).collect()))
    assert got == [r for r in expected({(1, 1): data[1, 1]}) if r[3] == 1]
    (path / "scan1" / "kdata_f1_e1.npy").write_bytes(b"broken")
    coords = load_arrays(spark, str(path), kdata=False, weights=False).where("frame = 1 and enc = 1")
    assert coords.columns == ["frame", "enc", "s", "kx", "ky", "kz"] and coords.count() == data[1, 1]["weights"].size
    with pytest.raises(Exception, match="magic"):
        asked.collect()


def test_filters_that_are_not_pushed_still_hold(spark, folder):
    path, data = folder
    df = load_arrays(spark, str(path))
    want = [r for r in expected(data) if (r[0] == 0 or r[1] == 1) and r[4] > 0 and r[2] % 3 == 1]
    assert sorted(map(tuple, df.where("(frame = 0 or enc = 1) and kx > 0 and s % 3 = 1").select(*COLUMNS).collect())) == want
    assert df.where("frame = 9").count() == 0 and df.where("frame is null").count() == 0 and df.where("frame = cast(null as int)").count() == 0
    assert df.where("not (frame = 0)").count() == sum(r[0] != 0 for r in expected(data))


def test_missing_real_and_empty_files(spark, tmp_path):
    np.save(tmp_path / "kdata_f0_e0.npy", np.array([[1.0, 2.0]]))
    np.save(tmp_path / "coords_f0_e0.npy", np.zeros((1, 2)))
    np.save(tmp_path / "weights_f1_e0.npy", np.ones(1))
    np.save(tmp_path / "weights_f2_e0.npy", np.ones(0))
    rows = sorted(map(tuple, load_arrays(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)
    assert rows == [(0, 0, 0, 0, 0.0, None, None, 1.0, 0.0, None), (0, 0, 1, 0, 0.0, None, None, 2.0, 0.0, None), (1, 0, 0, None, None, None, None, None, None, 1.0)]
    assert load_arrays(spark, str(tmp_path)).where("coil is not null").count() == 2
    np.save(tmp_path / "weights_f0_e0.npy", np.ones(3))
    with pytest.raises(Exception, match="number of samples"):
        load_arrays(spark, str(tmp_path)).where("frame = 0").collect()
    np.save(tmp_path / "weights_f3_e0.npy", np.ones(3, int))
    with pytest.raises(Exception, match="not floats"):
        load_arrays(spark, str(tmp_path)).where("frame = 3").collect()
    (tmp_path / "again").mkdir()
    np.save(tmp_path / "again" / "weights_f1_e0.npy", np.ones(1))
    with pytest.raises(Exception, match="two files"):
        load_arrays(spark, str(tmp_path)).where("frame = 1").collect()
    with pytest.raises(Exception, match="quantities"):
        load_arrays(spark, str(tmp_path), False, False, False)
