"""Constructed tensors, coordinate grids and sampling patterns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.tensor import Tensor


def grid_index(spark: SparkSession, shape: tuple[int, ...], names: tuple[str, ...]) -> DataFrame:
    """All index tuples of a shape, from one distributed range."""
    total, df = math.prod(shape), spark.range(math.prod(shape))
    step = total
    cols = []
    for n, name in zip(shape, names, strict=True):
        step //= n
        cols.append((F.floor(F.col("id") / step) % n).cast("int").alias(name))
    return df.select(*cols)


def full(spark: SparkSession, shape: tuple[int, ...], value: Column | float, names: tuple[str, ...] = ("i", "j", "k", "l", "m")) -> Tensor:
    names = names[: len(shape)]
    return Tensor(grid_index(spark, shape, names).withColumn("re", F.lit(value) if isinstance(value, int | float) else value), names)


def zeros(spark: SparkSession, shape: tuple[int, ...]) -> Tensor:
    return full(spark, shape, 0.0)


def ones(spark: SparkSession, shape: tuple[int, ...]) -> Tensor:
    return full(spark, shape, 1.0)


#: An uninitialised tensor has no values of its own; it is zeros here.
empty = zeros


def rand(spark: SparkSession, shape: tuple[int, ...], seed: int = 0) -> Tensor:
    """Uniform in [0, 1) from a hash of the index, so that a repeated task gives the same numbers."""
    names = ("i", "j", "k", "l", "m")[: len(shape)]
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11) / float(1 << 53)
    return full(spark, shape, h)


def grid_coords(spark: SparkSession, n: int, ndim: int) -> DataFrame:
    """-pi + 2 pi i / n on each axis."""
    names = ("x", "y", "z")[:ndim]
    at = grid_index(spark, (n,) * ndim, names)
    return at.withColumns({f"k{a}": -math.pi + F.col(a) * (2 * math.pi / n) for a in names})


def spokes(spark: SparkSession, n_spokes: int, n_samples: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Radial lines through the centre, evenly turned (golden ratio); samples outside the period are dropped."""
    df = grid_index(spark, (n_spokes, n_samples), ("spoke", "s"))
    z = (2 * F.col("spoke") + 1) / n_spokes - 1
    turn = F.col("spoke") * (math.pi * (3 - math.sqrt(5)))
    r = -math.pi + F.col("s") * (2 * math.pi / n_samples)
    flat = F.sqrt(1 - z * z)
    for k, (a, d) in enumerate(zip(("kx", "ky", "kz"), (flat * F.cos(turn), flat * F.sin(turn), z), strict=True)):
        shake = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + k), "spoke"), 11) / float(1 << 53) - 0.5) * noise
        df = df.withColumn(a, r * (d + shake))
    return df.where(reduce(lambda x, y: x & y, [F.abs(a) < math.pi for a in ("kx", "ky", "kz")]))


def cartesian(spark: SparkSession, imsize: tuple[int, int, int], keep: float = 1.0, seed: int = 0) -> DataFrame:
    """All grid frequencies, or a share of them by hash order."""
    df = grid_index(spark, imsize, ("x", "y", "z")).withColumns({f"k{a}": -math.pi + F.col(a) * (2 * math.pi / n) for a, n in zip("xyz", imsize, strict=True)})
    if keep >= 1:
        return df
    return df.orderBy(F.xxhash64(F.lit(seed), "x", "y", "z"), "x", "y", "z").limit(int(math.prod(imsize) * keep))


def mid_random(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Samples denser towards the centre: a cubed uniform on each axis."""
    u = [F.shiftrightunsigned(F.xxhash64(F.lit(seed + k), "id"), 11) / float(1 << 52) - 1.0 for k in range(3)]
    return spark.range(n).select(F.col("id").alias("s"), *[(math.pi * F.pow(x, 3)).alias(a) for x, a in zip(u, ("kx", "ky", "kz"), strict=True)])


def _uniform(seed: int, *keys: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def _normal(seed: int, *keys: str) -> Column:
    """A standard normal number from a hash of the keys (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - _uniform(seed, *keys))) * F.cos(2 * math.pi * _uniform(seed + 1, *keys))


def random_angles(spark: SparkSession, n_spokes: int, turns: float = 1.0, seed: int = 0) -> DataFrame:
    """(spoke, xangle, zangle): tilts below pi and turns below 2 pi `turns`."""
    return spark.range(n_spokes).select(F.col("id").alias("spoke"), (math.pi * _uniform(seed, "id")).alias("xangle"), (2 * math.pi * turns * _uniform(seed + 1, "id")).alias("zangle"))


def vipr_spokes(angles: DataFrame, n_samples: int, noise: float = 0.005, crop: float = 1.0, seed: int = 0) -> DataFrame:
    """(spoke, s, kx, ky, kz): lines from -pi / 3 to pi along z, tilted about x, then turned about z, one for each row of angles.

    Every coordinate is shaken by `noise` before that. With a crop other than 1 the lines are stretched by it, and samples
    outside the period go. A null angle gives null coordinates, which a crop drops.
    """
    gap = (4 / 3) / max(1, n_samples - 1)
    df = angles.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    x, y, z = (_normal(seed + 2 * k, "spoke", "s") * noise if noise else F.lit(0.0) for k in range(3))
    z = z + math.pi * (F.col("s") * gap - 1 / 3)
    cx, sx, cz, sz = F.cos("xangle"), F.sin("xangle"), F.cos("zangle"), F.sin("zangle")
    y, z = y * cx - z * sx, y * sx + z * cx
    x, y = x * cz - y * sz, x * sz + y * cz
    out = df.select("spoke", "s", *[(c * crop).alias(n) for c, n in ((x, "kx"), (y, "ky"), (z, "kz"))])
    return out if crop == 1 else out.where(reduce(lambda a, b: a & b, [F.abs(n) < math.pi for n in ("kx", "ky", "kz")]))
