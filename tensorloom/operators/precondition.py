"""Preconditioners of the coil-weighted normal operator on grids of one to three axes.

Both rest on correlations of the maps at all lags, taken by transforms on the grid of twice the modes, and on the frequencies'
kernel there (`toeplitz_lags`): nothing is listed by pairs of voxels, of samples, or of samples and lags.

Maps are (coil, axis..., sre, sim) with centred axes, frequencies (s, k<axis>) in radians. Cells that a map lacks are zero.
Rows of one coil and cell are summed. Without maps there is no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx
from tensorloom.operators import volumes
from tensorloom.operators.transforms import Sizes, kb_nufft, toeplitz_lags
from tensorloom.sources.storage import checkpointed


def _doubled(sizes: Sizes) -> Sizes:
    return {a: 2 * n for a, n in sizes.items()}


def _map_blocks(maps: DataFrame, sizes: Sizes, sign: int = 1) -> DataFrame:
    """The maps (sign -1: conjugates) in the middle of the doubled grid, as blocks of arrays."""
    at = [(F.col(a) + n).cast("int").alias(a) for a, n in sizes.items()]
    rows = maps.select("coil", *at, F.col("sre").cast("double").alias("re"), (F.col("sim") * sign).cast("double").alias("im"))
    return volumes.blocks(rows, _doubled(sizes))


def _correlations(boxes: DataFrame, sizes: Sizes, *over: str) -> DataFrame:
    """Blocks of the sum over m of z(m + d) conj z(m) at the lags d, -n .. n - 1 on each axis, summed over the keys `over`;
    times the number of cells of the doubled grid."""
    double = _doubled(sizes)
    power = volumes.power(volumes.transform(boxes, double, 0, ortho=False), *over)
    return volumes.transform(power, double, 1, sign=1, ortho=False)


def _with_kernel(lags: DataFrame, freqs: DataFrame, sizes: Sizes, weight: Column | None, oversampling: float, width: float) -> DataFrame:
    """The correlations times the sum over the frequencies of w e^(i k d), free of the factor of `_correlations`."""
    double = _doubled(sizes)
    kernel = toeplitz_lags(freqs, sizes, weight, oversampling, width)
    kernel = kernel.withColumns({c: F.col(c) / math.prod(double.values()) for c in ("re", "im")})
    return volumes.multiplied(lags, volumes.blocks(kernel, double))


def kspace_weights(maps: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s", weight: Column | None = None, oversampling: float = 2.0, width: float = 6.0) -> DataFrame:
    """(coil, key, p): the diagonal weights of samples that make A A^H nearest to the identity; on one axis, what
    `sense.kspace_preconditioner` gives by sums.

    1 / p at the sample k of coil i is the sum over coils j and lags d of c_ij(d) T(d) e^(-i k d), divided by |s_i|^2, c_ij being
    the correlation of s_i conj(s_j) and T the frequencies' kernel. There are coils^2 volumes of products, each one row of
    arrays a block; their powers are summed over j where they arise. The windowed type 2 reads the sums at the samples: one
    gather a coil. Samples without a coordinate have no weight, and rows of one key and place are given once (but count in
    the kernel each); where 1 / p is zero, p is 1.
    """
    double = _doubled(sizes)
    kind = maps.schema["coil"].dataType
    coils = [r["coil"] for r in maps.select("coil").distinct().collect()]
    if not coils:
        return freqs.select(F.lit(None).cast(kind).alias("coil"), key, F.lit(None).cast("double").alias("p")).where(F.lit(False))
    boxes = checkpointed(_map_blocks(maps, sizes))
    conjugates = boxes.select(F.col("coil").alias("_j"), F.explode(F.array(*[F.lit(c).cast(kind) for c in coils])).alias("coil"), "_b", "_re", F.transform("_im", lambda v: -v).alias("_im"))
    lags = _correlations(volumes.multiplied(conjugates, boxes), sizes, "_j")
    terms = volumes.rows(_with_kernel(lags, freqs.withColumnRenamed(key, "s"), sizes, weight, oversampling, width), double, 0)
    ks = [f"k{a}" for a in sizes]
    places = freqs.select(key, *ks).distinct()
    at = places.select(key, *[(F.col(f"k{a}") * (n / (2 * math.pi))).alias(f"k{a}") for a, n in double.items()])
    sums = kb_nufft(terms, at, double, oversampling, width, key, unique=True, most=freqs.count())
    power = maps.groupBy("coil").agg((F.sum(cplx("s").abs2()) / math.sqrt(math.prod(double.values()))).alias("_power"))
    p = F.col("_power") / F.nullif(F.abs("re"), F.lit(0.0))
    return sums.join(power, "coil").select("coil", key, F.coalesce(p, F.lit(1.0)).alias("p"))


def circulant_weights(maps: DataFrame, freqs: DataFrame, sizes: Sizes, weight: Column | None = None, oversampling: float = 2.0, width: float = 6.0) -> DataFrame:
    """(axis..., mre, mim) at the frequencies 0 .. n - 1: the inverse of the diagonal of F A F^H, A being the coil-weighted
    normal operator; on one axis, what `sense.circulant_build` gives by sums. Where that is zero, 1.

    The diagonal is the transform of the maps' correlations times the frequencies' kernel, at each second frequency of
    the doubled grid.
    """
    double = _doubled(sizes)
    lags = _correlations(_map_blocks(maps, sizes, -1), sizes, "coil")
    terms = _with_kernel(lags, freqs, sizes, weight, oversampling, width)
    out = volumes.rows(volumes.transform(terms, double, 0, ortho=False), double, 1)
    for a, n in sizes.items():
        out = out.where(F.pmod(F.col(a) - n, F.lit(2)) == 0).withColumn(a, F.pmod(F.floor((F.col(a) - n) / 2), F.lit(n)).cast("int"))
    d = F.nullif(F.col("re") / math.prod(sizes.values()), F.lit(0.0))
    return out.select(*sizes, F.coalesce(1 / d, F.lit(1.0)).alias("mre"), F.lit(0.0).alias("mim"))


def circulant_blocks(weights: DataFrame, sizes: Sizes) -> DataFrame:
    """The weights as blocks of arrays, for many applications."""
    return volumes.blocks(weights.withColumnsRenamed({"mre": "re", "mim": "im"}), sizes, side=1)


def circulant_apply(image: DataFrame, weights: DataFrame, sizes: Sizes) -> DataFrame:
    """The inverse transform of the weights times the transform, for each image (keys..., axis..., re, im) on centred axes.

    Images stay blocks of arrays in between; weights come as `circulant_weights` or `circulant_blocks` makes them.
    """
    kernel = weights if "_re" in weights.columns else circulant_blocks(weights, sizes)
    moved = image.withColumns({a: (F.col(a) + n // 2).cast("int") for a, n in sizes.items()})
    there = volumes.transform(volumes.blocks(moved, sizes), sizes, 0, centred=False)
    back = volumes.rows(volumes.transform(volumes.multiplied(there, kernel), sizes, 1, sign=1, centred=False), sizes, 0)
    return back.withColumns({a: F.col(a) - n // 2 for a, n in sizes.items()}).select(*image.columns)
