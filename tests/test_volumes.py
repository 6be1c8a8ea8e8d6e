"""Blocks of arrays, and windows over tiles, beside numpy and direct sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import sense, transforms, volumes
from tensorloom.plans import linear


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of few cells, tiles of few cells and groups of few samples: the code of large volumes on small ones."""
    monkeypatch.setattr(volumes, "BLOCK_CELLS", 100)
    monkeypatch.setattr(volumes, "TILE_EDGE", {1: 8, 2: 8, 3: 8})
    monkeypatch.setattr(volumes, "TILE_SAMPLES", 20)


def frame(spark, z, axes):
    rows = [(0, *map(int, at), float(z[at].real), float(z[at].imag)) for at in np.ndindex(z.shape)]
    return spark.createDataFrame(rows, "coil int, " + ", ".join(f"{a} int" for a in axes) + ", re double, im double")


def dense(df, axes, shape):
    out = np.zeros(shape, complex)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = complex(r["re"], r["im"])
    return out


@pytest.mark.parametrize("shape", [(6, 5), (8, 7, 5), (3, 4, 2)])
def test_transform_equals_numpy(spark, small_blocks, shape):
    rng, axes = np.random.default_rng(0), "xyz"[: len(shape)]
    z = rng.normal(size=shape) + 1j * rng.normal(size=shape)
    sizes = dict(zip(axes, shape, strict=True))
    f = transforms.fft_nd(spark, sizes)
    got = dense(f(frame(spark, z, axes)), axes, shape)
    assert np.allclose(got, np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(z), norm="ortho")))
    assert np.allclose(dense(f.N(frame(spark, z, axes)), axes, shape), z)


def test_a_block_sends_one_array_to_each_other(spark, small_blocks):
    sizes = {"x": 8, "y": 6, "z": 5}
    boxes = volumes.blocks(frame(spark, np.ones((8, 6, 5), complex), "xyz"), sizes)
    across, along = (-(-n // t) for n, t in zip((8, 6), volumes.thickness(sizes), strict=True))
    assert boxes.count() == across > 1 and volumes.transform(boxes, sizes, 0).count() == along > 1
    plan = volumes.transform(boxes, sizes, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("few", [False, True])
def test_windowed_transform_of_sixteen_cubed(spark, request, few):
    """Type 2 and its adjoint against the direct sum, in one tile and in many, with hot and wrapping tiles."""
    if few:
        request.getfixturevalue("small_blocks")
    rng, n = np.random.default_rng(1), 16
    z = rng.normal(size=(n, n, n)) + 1j * rng.normal(size=(n, n, n))
    k = np.concatenate([rng.uniform(-8, 8, (150, 3)), rng.normal(0, 0.3, (60, 3)), [[-8, -8, 8 - 1e-9], [8 - 1e-9, 0, 0], [0, 0, 0]]])
    coords = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(k)] + [(-1, None, 0.0, 0.0)], "s int, kx double, ky double, kz double")
    sizes = {"x": n, "y": n, "z": n}
    got = transforms.kb_nufft(frame(spark, z, "xyz"), coords, sizes, 2.0, 6.0).collect()
    assert len(got) == len(k) and {r["coil"] for r in got} == {0}
    turn = [np.exp(-2j * np.pi / n * np.outer(k[:, a], np.arange(n) - n // 2)) for a in range(3)]
    want = np.einsum("xyz,sx,sy,sz->s", z, *turn) / n**1.5
    have = np.zeros(len(k), complex)
    have[[r["s"] for r in got]] = [complex(r["re"], r["im"]) for r in got]
    assert np.linalg.norm(have - want) < 1e-3 * np.linalg.norm(want)
    y = rng.normal(size=len(k)) + 1j * rng.normal(size=len(k))
    values = spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(y)], "s int, re double, im double")
    back = dense(transforms.kb_nufft_adjoint(coords.join(values, "s"), sizes, 2.0, 6.0), "xyz", z.shape)
    assert np.isclose(np.vdot(have, y), np.vdot(z, back))


def test_no_list_is_broadcast_by_estimate(spark, sf_dir):
    """Samples and cells meet in a cogroup; no exploded side reaches a broadcast."""
    plan = linear.kb_nufft_3d(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "BroadcastExchange" not in plan


def test_coils_share_samples(spark, small_blocks, monkeypatch):
    """Volumes with a key of their own, more than a group takes at once."""
    rng = np.random.default_rng(2)
    z = rng.normal(size=(3, 10, 10)) + 0j
    grid = frame(spark, z[0], "xy").withColumn("coil", F.lit(0))
    for c in (1, 2):
        grid = grid.union(frame(spark, z[c], "xy").withColumn("coil", F.lit(c)))
    k = rng.uniform(-4, 14, (70, 2))
    coords = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(k)], "s int, kx double, ky double")
    beta = transforms.kernel_shape()
    got = {(r["coil"], r["s"]): r["re"] for r in transforms.interpolate(grid, coords, {"x": 10, "y": 10}, 4.0, beta).collect()}
    for (c, s), v in got.items():
        want = 0.0
        for i in range(math.ceil(k[s, 0] - 2), math.floor(k[s, 0] + 2) + 1):
            for j in range(math.ceil(k[s, 1] - 2), math.floor(k[s, 1] + 2) + 1):
                w = transforms._kernel(np.array([(i - k[s, 0]) / 2, (j - k[s, 1]) / 2]), beta)
                want += z[c, i % 10, j % 10].real * w[0] * w[1]
        assert abs(v - want) < 1e-8
    assert len(got) == 210


def test_empty_tables(spark):
    grid = spark.createDataFrame([], "x int, y int, re double, im double")
    coords = spark.createDataFrame([], "s int, kx double, ky double")
    beta = transforms.kernel_shape()
    assert transforms.interpolate(grid, coords, {"x": 4, "y": 4}, 4.0, beta).count() == 0
    assert transforms.gridding(coords.withColumns({"re": F.lit(1.0), "im": F.lit(0.0)}), {"x": 4, "y": 4}, 4.0, beta).count() == 0
    assert transforms.fft_nd(spark, {"x": 4, "y": 4})(grid).count() == 0
    with pytest.raises(ValueError):
        volumes.thickness({})


@pytest.mark.parametrize("sizes, width", [({"x": 8, "y": 6, "z": 4}, 6.0), ({"x": 64}, 4.0)])
def test_small_grids_sum_as_tiles_do_and_send_no_sample(spark, monkeypatch, sizes, width):
    k = [(F.rand(3 + i) * 3 * n - n).alias(f"k{a}") for i, (a, n) in enumerate(sizes.items())]
    s = spark.range(3000).select((F.col("id") % 3).cast("int").alias("frame"), F.floor(F.col("id") / 2).alias("s"), *k, F.rand(1).alias("re"), F.rand(2).alias("im"))
    s = s.unionByName(s.limit(2).withColumn("kx", F.lit(None).cast("double"))).localCheckpoint()
    names, beta = list(sizes), 9.0
    here = lambda: transforms.gridding(s, sizes, width, beta, "frame")
    grid = here().localCheckpoint()
    coils = grid.withColumn("coil", F.lit(0)).unionByName(grid.withColumns({"coil": F.lit(1), "re": F.col("re") * 2}))
    there = lambda unique=False: transforms.interpolate(coils, s.select("frame", "s", *[f"k{a}" for a in sizes]), sizes, width, beta, "s", unique)
    got, values, count = here().toPandas(), there().toPandas(), there(True).count()
    monkeypatch.setattr(volumes, "WHOLE_CELLS", 0)
    for one, other, by in ((got, here().toPandas(), ["frame", *names]), (values, there().toPandas(), ["frame", "coil", "s"])):
        both = one.merge(other, on=by, suffixes=("", "_o"))
        assert len(both) == len(one) == len(other)
        assert np.allclose(both[["re", "im"]], both[["re_o", "im_o"]], atol=1e-9 * np.abs(both["re"]).max())
    assert count == 6000


def test_the_plan_of_a_small_grid_groups_no_samples(spark):
    s = spark.range(100).select((F.col("id") / 10).alias("kx"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    plan = transforms.gridding(s, {"x": 64}, 4.0, 9.0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("kind", ["int", "string", "double"])
def test_small_grids_of_their_own_meet_many_to_a_group_as_alone(spark, monkeypatch, split, kind):
    """With repeated and null keys, null batches, coordinates without a place, batches without modes and without samples, and full batches."""
    if split:
        monkeypatch.setattr(volumes, "TILE_SAMPLES", 10)
        monkeypatch.setattr(volumes, "GROUP_SAMPLES", 50)
    sizes = {"x": 4, "y": 2}
    none = lambda c, at: F.when(c != at, c)
    batch = none(F.floor(F.col("id") / 2) % 41, 7).alias("vec_id")
    k = [F.when(F.col("id") % 29 != 3, (F.rand(3 + i) - 0.5) * n).alias(f"k{a}") for i, (a, n) in enumerate(sizes.items())]
    coords = spark.range(600).select(F.when(F.col("id") > 500, 1).otherwise(batch).cast("long").alias("vec_id"), none(F.floor(F.col("id") / 2), 20).cast(kind).alias("s"), *k).localCheckpoint()
    cell = [F.floor(F.col("id") / 2 % 4).cast("int").alias("x"), (F.col("id") % 2).cast("int").alias("y")]
    modes = spark.range(45 * 8).select(none(F.floor(F.col("id") / 8), 7).cast("long").alias("vec_id"), *cell, F.randn(1).alias("re"), F.randn(2).alias("im")).where("vec_id is null or vec_id != 11").localCheckpoint()
    asked = [
        (lambda: transforms.kb_nufft(modes, coords, sizes, 2.0, 6.0), ["vec_id", "s"]),
        (lambda: transforms.kb_nufft(modes, coords, sizes, 2.0, 6.0, unique=True).groupBy("vec_id", "s").agg(F.count("*").alias("n"), F.sum("re").alias("re"), F.sum("im").alias("im")), ["vec_id", "s"]),
        (lambda: transforms.kb_nufft_normal(modes, coords, sizes, 2.0, 6.0), ["vec_id", "x", "y"]),
    ]
    got = [run().toPandas() for run, _ in asked]
    monkeypatch.setattr(volumes, "WHOLE_CELLS", 0)
    for one, (run, by) in zip(got, asked, strict=True):
        other = run().toPandas()
        assert list(one.columns) == list(other.columns) and len(one) == len(other) > 100
        both = one.merge(other, on=by, suffixes=("", "_o"))
        assert len(both) == len(one)
        assert all(np.allclose(both[c], both[f"{c}_o"], atol=1e-12) for c in one.columns if c not in by)


def test_the_normal_operator_of_many_batches_groups_no_batch_alone(spark, sf_dir):
    """Each sample is sent once: no group or join of samples by batch, and nothing is read twice."""
    plan = linear.kb_nufft_normal(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroups") == 1 and "FlatMapGroups" not in plan and "Join" not in plan
    assert "_g" in plan.split("FlatMapCoGroups")[1].split("\n")[0]


def test_products_of_images_and_maps_are_not_sent(spark, sf_dir):
    """Images go to groups as cells, once; no join or list holds a volume for each image and coil."""
    df = linear.sense_grid_normal(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    top = next((i for i, line in enumerate(plan) if "FlatMapCoGroups" in line), len(plan))
    below = plan[top + 1 :]
    images = below[: next((i for i, line in enumerate(below) if i and line.find("- ") == below[0].find("- ")), 0)]
    assert images and not any(word in line for line in plan[:top] + images for word in ("Join", "MapInArrow", "collect_list"))
    assert df.count() == 32 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


@pytest.mark.parametrize("key", ["id", "CAST(id AS STRING)", "CAST(id AS DOUBLE)", None])
@pytest.mark.parametrize("few", [False, True])
def test_images_and_maps_in_one_visit_equal_joins(spark, monkeypatch, key, few):
    """Beside the joins, for missing, repeated, null and infinite cells of images and maps; in many groups of few cells, and in one."""
    if few:
        monkeypatch.setattr(volumes, "MAP_CELLS", 300)
        monkeypatch.setattr(volumes, "GROUP_SAMPLES", 8)
        monkeypatch.setattr(volumes, "GROUP_CELLS", 500)
        monkeypatch.setattr(volumes, "VISIT_CELLS", 400)
    sizes = {"x": 3, "y": 4, "z": 2}
    at, own = ["CAST(c % 3 AS INT) - 1 AS x", "CAST(c / 3 AS INT) % 4 - 2 AS y", "CAST(c / 12 AS INT) - 1 AS z"], [f"{key} AS v"] * bool(key)
    odd = ["id = 1 AND c < 20", "id = 2 AND c > 3", "id = 5 AND c != 7"]
    every = spark.range(9).crossJoin(spark.range(24).withColumnRenamed("id", "c"))
    image = every.where(f"NOT ({' OR '.join(odd)})").unionByName(every.where("id = 6 AND c % 5 = 0")).unionByName(every.where("id = 3").selectExpr("CAST(NULL AS BIGINT) AS id", "c"))
    re = "CASE WHEN id = 4 AND c = 2 THEN NULL WHEN id = 4 AND c = 3 THEN double('NaN') WHEN id = 7 AND c = 1 THEN double('Infinity') ELSE sin(1.7 * c + coalesce(id, 20)) END AS re"
    beside = spark.sql("SELECT 1L AS id, 100 AS x, 0 AS y, 0 AS z, 1.0D AS re, 1.0D AS im").selectExpr(*own, *sizes, "re", "im")
    image = image.selectExpr(*own, *at, re, "cos(c * coalesce(id, 11) + 0.3) AS im").unionByName(beside)
    image = image if key else image.where("abs(re) < 9")
    coils = spark.range(5).crossJoin(spark.range(24).withColumnRenamed("id", "c")).where("NOT (id = 2 AND c > 5) AND c != 23").selectExpr("id", "c")
    coils = coils.unionByName(coils.where("id = 1 AND c < 9"))
    sim = "CASE WHEN c = 4 OR id = 3 AND c < 10 THEN NULL ELSE cos(2.3 * c - id) END AS sim"
    maps = coils.selectExpr("CASE WHEN id = 4 THEN NULL ELSE id END AS coil", *at, "sin(c + 3.1 * id) AS sre", sim)
    freqs = spark.range(50).selectExpr("id AS s", "sin(id * 1.3) * 3 AS kx", "cos(id * 2.1) * 3 AS ky", "sin(id * 0.7) * 3 AS kz")
    spectrum = transforms.toeplitz_spectrum(freqs, sizes).cache()
    got = sense.toeplitz_normal(image, maps, spectrum, sizes)
    want = sense.combined(transforms.toeplitz_apply(sense.weighted(image, maps, sizes), spectrum, sizes), maps, sizes)
    assert got.dtypes == want.dtypes
    key_of = ["v"] * bool(key) + list(sizes)
    got, want = ({tuple(r[k] for k in key_of): (r.re, r.im) for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and any(v[0] is None for v in want.values())
    for i, values in want.items():
        for one, other in zip(values, got[i], strict=True):
            assert one == other or one is not None and other is not None and (math.isclose(one, other, rel_tol=1e-9, abs_tol=1e-9) or not math.isfinite(one) and not math.isfinite(other))


def test_images_without_maps_kernel_or_cells(spark):
    sizes = {"x": 3, "y": 2}
    image = spark.sql("SELECT 1 AS v, 0 AS x, 0 AS y, 1.0D AS re, 0.0D AS im")
    maps = spark.sql("SELECT 0 AS coil, 0 AS x, 0 AS y, 1.0D AS sre, 0.0D AS sim")
    spectrum = spark.sql("SELECT 0 AS x, 0 AS y, 1.0D AS mre, 0.0D AS mim")
    assert sense.toeplitz_normal(image, maps, spectrum, sizes).count() == 1
    for none in ((image.limit(0), maps, spectrum), (image, maps.limit(0), spectrum), (image, maps, spectrum.limit(0)), (image, maps.where("x = 1"), spectrum)):
        assert sense.toeplitz_normal(*none, sizes).count() == 0
