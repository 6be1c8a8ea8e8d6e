"""Reductions over coils, encodes and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx


def coil_combine(df: DataFrame, *voxel: str, normalised: bool = False) -> DataFrame:
    """The sum over coils of conj(map) times image, per voxel; normalised: divided by the sum of |map|^2 (null where that is zero).

    Rows are (coil..., voxel..., re, im, sre, sim). Sums are partial before the shuffle by voxel.
    """
    z = cplx("s").conj() * cplx()
    sums = df.groupBy(*voxel).agg(F.sum(z.re).alias("re"), F.sum(z.im).alias("im"), F.sum(cplx("s").abs2()).alias("_w"))
    if normalised:
        sums = sums.withColumns({c: F.col(c) / F.nullif(F.col("_w"), F.lit(0.0)) for c in ("re", "im")})
    return sums.drop("_w")


def rss(df: DataFrame, *voxel: str, floor: float = 0.0) -> DataFrame:
    """The root of the sum of squares over coils, plus `floor` times its largest value."""
    roots = df.groupBy(*voxel).agg(F.sqrt(F.sum(cplx().abs2())).alias("rss"))
    return roots.withColumn("rss", F.col("rss") + floor * roots.agg(F.max("rss")).scalar()) if floor else roots


def segmented_sum(df: DataFrame, index: str, value: str, length: int) -> DataFrame:
    """Sums of `length` neighbours."""
    return df.groupBy(F.floor(F.col(index) / length).cast("long").alias("segment")).agg(F.sum(value).alias(value))


def normalise(df: DataFrame, value: str) -> DataFrame:
    """Divided by the mean absolute value (null if that is zero)."""
    return df.withColumn(value, F.col(value) / F.nullif(df.agg(F.avg(F.abs(value))).scalar(), F.lit(0.0)))


def mean_magnitude(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(cplx().abs()).alias("magnitude"))
