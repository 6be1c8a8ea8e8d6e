"""Filters on sample coordinates and index selections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.tensor import Tensor

AXES = ("kx", "ky", "kz")
#: Fixed value: rescaled coordinates stay inside the period by this factor of pi.
EDGE = 0.99999


def crop_samples(samples: DataFrame, extent: tuple[float, float, float], crop: float = 1.0, pre: float = 1.0, post: float = 1.0) -> DataFrame:
    """Samples strictly inside half the extent times `crop` on all axes, rescaled to the period and clamped to it."""
    half = [0.5 * n * crop for n in extent]
    inside = samples.withColumns({a: F.col(a) * pre for a in AXES})
    for a, x in zip(AXES, half, strict=True):
        inside = inside.where(F.abs(a) < x)
    top = EDGE * math.pi
    return inside.withColumns({a: F.greatest(F.lit(-top), F.least(F.lit(top), F.col(a) * (post * math.pi / x))) for a, x in zip(AXES, half, strict=True)})


def crop_samples_to_largest(samples: DataFrame, extent: tuple[float, float, float], crop: float = 1.0) -> DataFrame:
    """The same selection; what is left is scaled so that the largest coordinate of any axis comes to pi."""
    inside = samples
    for a, n in zip(AXES, extent, strict=True):
        inside = inside.where(F.abs(a) < 0.5 * n * crop)
    largest = inside.agg(F.max(F.greatest(*[F.abs(a) for a in AXES]))).scalar()
    return inside.withColumns({a: F.col(a) * (math.pi / F.nullif(largest, F.lit(0.0))) for a in AXES})


def center_weights(samples: DataFrame, extent: tuple[float, float, float], width: float) -> DataFrame:
    """Samples within `width` grid cells of the centre on all axes; coordinates in radians."""
    for a, n in zip(AXES, extent, strict=True):
        samples = samples.where(F.abs(F.col(a) * (n / (2 * math.pi))) < width)
    return samples


def box(tensor: Tensor, **ranges: tuple[int, int]) -> Tensor:
    """Half-open index ranges."""
    df = tensor.df
    for name, (lo, hi) in ranges.items():
        df = df.where((F.col(name) >= lo) & (F.col(name) < hi))
    return Tensor(df, tensor.index, tensor.child, tensor.values)


def radius_decay(r: Column, radius: float, decay: float) -> Column:
    """1 inside the radius, a Gaussian fall-off outside."""
    return F.when(r > radius, F.exp(-F.pow(decay * (r - radius) / radius, 2))).otherwise(F.lit(1.0))


def subset(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, in every batch."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def hash01(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from an id, the same in every engine: multiplication modulo 2^32."""
    return F.pmod((key + seed) * F.lit(2654435761), F.lit(4294967296)) / 4294967296.0


def bernoulli(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    return df.where(hash01(F.col(key), seed) < share)


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def blocks_overlap(a: str, b: str, axes: tuple[str, ...], size: int) -> Column:
    """Whether blocks at a.x.. and b.x.. of equal size share a cell: on all axes."""
    out = F.lit(True)
    for x in axes:
        out = out & (F.abs(F.col(f"{a}.{x}") - F.col(f"{b}.{x}")) < size)
    return out


def overlapping_blocks(df: DataFrame, axes: tuple[str, ...], size: int) -> DataFrame:
    """(a<axis>..., b<axis>..., pairs): for each two places at which blocks of equal size start and share a cell, the pairs of blocks.

    Blocks at one place are counted before they meet. Places meet in the coarse cells (of the block's size) that their
    blocks touch, and a pair counts in the first cell that both touch, on all axes: an equal join, whatever the place.
    """
    places = df.groupBy(*axes).agg(F.count("*").alias("n"))
    for x in axes:
        first = F.floor(F.col(x) / size)
        places = places.withColumn(f"_first_{x}", first).withColumn(f"_cell_{x}", F.explode(F.array_distinct(F.array(first, F.floor((F.col(x) + size - 1) / size)))))
    cells = [f"_cell_{x}" for x in axes]
    a, b = (places.select(*cells, *[F.col(x).alias(f"{e}{x}") for x in axes], *[F.col(f"_first_{x}").alias(f"_{e}{x}") for x in axes], F.col("n").alias(f"_{e}n")) for e in "ab")
    met = a.join(b, cells)
    for x in axes:
        met = met.where((F.col(f"_cell_{x}") == F.greatest(f"_a{x}", f"_b{x}")) & (F.abs(F.col(f"a{x}") - F.col(f"b{x}")) < size))
    left, right = F.struct(*[F.col(f"a{x}") for x in axes]), F.struct(*[F.col(f"b{x}").alias(f"a{x}") for x in axes])
    pairs = F.when(left == right, F.expr("_an * (_an - 1) div 2")).otherwise(F.col("_an") * F.col("_bn"))
    return met.where(left <= right).select(*[f"a{x}" for x in axes], *[f"b{x}" for x in axes], pairs.cast("long").alias("pairs"))
