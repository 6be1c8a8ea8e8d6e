"""Coil-weighted transforms, density compensation, preconditioning and coil compression."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import Cplx, cis, cplx
from tensorloom.operators import direct, volumes
from tensorloom.operators.linop import Linop, diagonal
from tensorloom.operators.transforms import Sizes, counted_side, fft, fft_nd, gridding, interpolate, nufft1, nufft2, nufft_normal, toeplitz_apply, toeplitz_blocks, toeplitz_kernel
from tensorloom.sources.storage import checkpointed

Change = Callable[[DataFrame], DataFrame]


def weighted(image: DataFrame, maps: DataFrame, sizes: Sizes) -> DataFrame:
    """Image times map for each coil: (batch..., coil, mode..., re, im)."""
    axes = list(sizes)
    z = cplx() * cplx("s")
    batch = [c for c in image.columns if c not in (*axes, "re", "im")]
    return image.join(maps, axes).select(*batch, "coil", *axes, z.re.alias("re"), z.im.alias("im"))


def combined(images: DataFrame, maps: DataFrame, sizes: Sizes) -> DataFrame:
    """The sum over coils of conj(map) times coil image. An image without a coil is the same for every coil."""
    axes = list(sizes)
    z = cplx() * cplx("s").conj()
    batch = [c for c in images.columns if c not in (*axes, "coil", "re", "im")]
    return images.join(maps, [*["coil"] * ("coil" in images.columns), *axes]).groupBy(*batch, *axes).agg(F.sum(z.re).alias("re"), F.sum(z.im).alias("im"))


def forward(image: DataFrame, maps: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s") -> DataFrame:
    """(batch..., coil, key, re, im): the type-2 transform of each weighted image. Columns that image and frequencies share are batches."""
    return nufft2(weighted(image, maps, sizes), freqs, sizes, key)


def adjoint(samples: DataFrame, maps: DataFrame, sizes: Sizes, key: str = "s") -> DataFrame:
    """Samples (batch..., coil, key, k<axis>, re, im) to the combined image; coils by their ids, as forward. Without a coil column
    they are every coil's, and are summed once."""
    return combined(nufft1(samples, sizes, key), maps, sizes)


def normal(image: DataFrame, maps: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s", between: Change | None = None) -> DataFrame:
    """The adjoint of the forward transform, with a change of the samples in between if wanted.

    Without one, or with a residual of data that all coils share, no sample leaves its task (on a grid of at most
    `direct.MODES` cells): the data meet the frequencies once, whatever the number of coils.
    """
    same = [c for c in image.columns if c in freqs.columns and c not in ("re", "im")]
    if math.prod(sizes.values()) <= direct.MODES and (between is None or isinstance(between, Residual) and {*between.keys} <= {key, *same}):
        known = freqs.select(key, *same, *[f"k{a}" for a in sizes])
        if between is not None:
            known = between.beside(known)
        found = direct.normal(weighted(image, maps, sizes), known, sizes, key, None if between is None else ("_dre", "_dim", "_dw"))
        return combined(found, maps, sizes)
    samples = forward(image, maps, freqs, sizes, key).join(freqs.select(key, *same, *[f"k{a}" for a in sizes]), [key, *same])
    return adjoint(between(samples) if between else samples, maps, sizes, key)


def normal_matrix(maps: DataFrame, freqs: DataFrame, n: int, key: str = "s", weight: str | None = None) -> DataFrame:
    """(batch..., n, m, mre, mim): `normal` on one axis of n modes, written out; the frequencies' other columns are batches.

    The sum over the coils of conj(map at n) times map at m, times the Toeplitz kernel at n - m: exact, and the
    frequencies are summed once, whatever the number of images that it is applied to.
    """
    batch = tuple(c for c in freqs.columns if c not in (key, "kn", weight))
    other = maps.select("coil", F.col("n").alias("m"), F.col("sre").alias("_re"), F.col("sim").alias("_im"))
    z = cplx("s").conj() * cplx("_")
    gram = maps.join(other, "coil").groupBy("n", "m").agg(F.sum(z.re).alias("gre"), F.sum(z.im).alias("gim")).withColumn("d", F.col("n") - F.col("m"))
    e = cplx("g") * cplx("m")
    return gram.join(toeplitz_kernel(freqs, n, F.col(weight) if weight else None, batch), "d").select(*batch, "n", "m", e.re.alias("mre"), e.im.alias("mim"))


def normal_adjoint(samples: DataFrame, maps: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s") -> DataFrame:
    return forward(adjoint(samples, maps, sizes, key), maps, freqs, sizes, key)


@dataclass(frozen=True)
class Residual:
    """Less the measured data, times the weights: what solvers put between the two halves."""

    data: DataFrame | None
    weight: str | None
    keys: tuple[str, ...]

    def __call__(self, samples: DataFrame) -> DataFrame:
        out, value = samples, cplx()
        if self.data is not None:
            cols = [*self.keys, F.col("re").alias("_dre"), F.col("im").alias("_dim")] + [self.weight] * bool(self.weight)
            out, value = out.join(self.data.select(*cols), list(self.keys)), cplx() - cplx(re="_dre", im="_dim")
        if self.weight:
            value = value.scale(F.col(self.weight))
        return out.withColumns({"re": value.re, "im": value.im}).drop("_dre", "_dim", *[self.weight] * bool(self.weight))

    def beside(self, freqs: DataFrame) -> DataFrame:
        """The frequencies with the data (_dre, _dim) and weights (_dw) of their samples."""
        weight = F.col(self.weight) if self.weight else F.lit(1.0)
        if self.data is None:
            return freqs.withColumns({"_dre": F.lit(0.0), "_dim": F.lit(0.0), "_dw": weight})
        return freqs.join(self.data.select(*self.keys, F.col("re").alias("_dre"), F.col("im").alias("_dim"), weight.alias("_dw")), list(self.keys))


def residual(data: DataFrame | None = None, weight: str | None = None, *keys: str) -> Residual:
    return Residual(data, weight, keys)


def coil_map_normal(maps: DataFrame, image: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s") -> DataFrame:
    """conj(image) times the normal transform of image times map, coil by coil: the operator of map estimation."""
    axes = list(sizes)
    products = weighted(image, maps, sizes)
    samples = nufft2(products, freqs, sizes, key).join(freqs.select(key, *[f"k{a}" for a in sizes]), key)
    z = cplx() * cplx("_").conj()
    known = image.select(*axes, F.col("re").alias("_re"), F.col("im").alias("_im"))
    return nufft1(samples, sizes, key).join(known, axes).select("coil", *axes, z.re.alias("re"), z.im.alias("im"))


def circulant(spark, d: DataFrame, n: int) -> Linop:
    """The inverse transform of d times the transform: applied along i; d has (i, mre, mim)."""
    f = fft(spark, n, centred=False)
    return f.H @ diagonal(d) @ f


def circulant_build(maps: DataFrame, freqs: DataFrame, n: int, weight: Column | None = None) -> DataFrame:
    """(i, mre, mim): the inverse of the diagonal of F A F^H, A being the coil-weighted normal operator on one axis: what
    `circulant` applies. Where that is zero, 1. Frequencies are (s, kn); weights count as in the normal operator."""
    w = F.lit(1.0) if weight is None else weight
    a = normal_matrix(maps, freqs.withColumn("_w", w), n, weight="_w")
    z = cplx("m") * cis((F.col("n") - F.col("m")) * F.col("i") * (-2 * math.pi / n))
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    sums = a.select("n", "m", "mre", "mim", at).groupBy("i").agg((F.sum(z.re) / n).alias("d"))
    return sums.select("i", F.coalesce(1 / F.nullif(F.col("d"), F.lit(0.0)), F.lit(1.0)).alias("mre"), F.lit(0.0).alias("mim"))


def kspace_preconditioner(maps: DataFrame, freqs: DataFrame, n: int, key: str = "s", weight: Column | None = None) -> DataFrame:
    """(coil, key, p): the diagonal weights of samples that make A A^H, on one axis, nearest to the identity.

    1 / p at the sample k of coil i is the sum over all samples k' (with their weights) and coils j of
    |sum over n of s_i(n) conj(s_j(n)) e^(i (k' - k) n)|^2, divided by |s_i|^2: the correlations of map products at each lag d,
    times the frequencies' kernel at d, summed at k. Nothing is summed over pairs of samples. Where 1 / p is zero, p is 1.
    """
    other = maps.select(F.col("coil").alias("_j"), "n", F.col("sre").alias("_re"), F.col("sim").alias("_im"))
    z = cplx("s") * cplx("_").conj()
    pair = maps.join(other, "n").select("coil", "_j", "n", z.re.alias("pre"), z.im.alias("pim"))
    second = pair.select("coil", "_j", F.col("n").alias("m"), F.col("pre").alias("qre"), F.col("pim").alias("qim"))
    c = cplx("p") * cplx("q").conj()
    lags = pair.join(second, ["coil", "_j"]).groupBy("coil", (F.col("n") - F.col("m")).cast("int").alias("d")).agg(F.sum(c.re).alias("cre"), F.sum(c.im).alias("cim"))
    e = cplx("c") * cplx("m")
    terms = checkpointed(lags.join(toeplitz_kernel(freqs, n, weight), "d").select("coil", "d", e.re.alias("re"), e.im.alias("im")))
    power = maps.groupBy("coil").agg(F.sum(cplx("s").abs2()).alias("_power"))
    at = freqs.select(key, "kn").withColumn("d", F.explode(F.sequence(F.lit(1 - n), F.lit(n - 1)))).join(counted_side(terms), "d")
    inverse = at.groupBy("coil", key).agg(F.sum((cplx() * cis(-F.col("kn") * F.col("d"))).re).alias("_q")).join(power, "coil")
    return inverse.select("coil", key, F.coalesce(F.col("_power") / F.nullif(F.abs("_q"), F.lit(0.0)), F.lit(1.0)).alias("p"))


def toeplitz_normal(image: DataFrame, maps: DataFrame, spectrum: DataFrame, sizes: Sizes) -> DataFrame:
    """`normal` by the frequencies' kernel on the doubled grid (`toeplitz_spectrum`), which all images and coils share.

    Small images are multiplied by the maps, transformed, and combined in one visit (`volumes.convolved`).
    """
    kernel = spectrum if "_re" in spectrum.columns else toeplitz_blocks(spectrum, sizes)
    if "coil" not in image.columns and volumes.convolvable(image, kernel, sizes):
        return volumes.convolved(image, maps, kernel, sizes)
    return combined(toeplitz_apply(weighted(image, maps, sizes), kernel, sizes), maps, sizes)


def density_weights(coords: DataFrame, sizes: Sizes, width: float, beta: float, rounds: int, key: str = "s", *batch: str) -> DataFrame:
    """(batch..., key, w): w divided by |G^H G w|, again and again, from w = 1; G is the window's gridding. Where that is zero, w stays.

    Each round grids and interpolates; its weights are kept in the shared folder. Each batch has a grid of its own, and each row
    is a sample of its own: it carries its coordinates and weight along, and no join brings them back.
    """
    ks = [f"k{a}" for a in sizes]
    w = coords.select(*batch, F.struct(key, *ks, F.lit(1.0).alias("re")).alias("_at"))
    w = checkpointed(w)
    some = not batch or volumes.few(w.select(*batch))
    for _ in range(rounds):
        at = w.select(*batch, "_at", *[F.col(f"_at.{c}").alias(c) for c in ks])
        grid = gridding(at.select(*batch, *ks, F.col("_at.re").alias("re"), F.lit(0.0).alias("im")), sizes, width, beta, *batch, some=some)
        there = interpolate(grid, at, sizes, width, beta, "_at", unique=True)
        d = F.nullif(cplx().abs(), F.lit(0.0))
        next_w = F.coalesce(F.col("_at.re") / d, F.col("_at.re"))
        w = checkpointed(there.select(*batch, F.struct(F.col(f"_at.{key}").alias(key), *[F.col(f"_at.{c}").alias(c) for c in ks], next_w.alias("re")).alias("_at")))
    return w.select(*batch, F.col(f"_at.{key}").alias(key), F.col("_at.re").alias("w"))


def gridding_reconstruction(samples: DataFrame, maps: DataFrame, weights: DataFrame, sizes: Sizes, key: str = "s") -> DataFrame:
    """Weighted adjoint per coil, combined and divided by the maps' power (null where that is zero)."""
    axes = list(sizes)
    z = cplx().scale(F.col("w"))
    dense = samples.join(weights, key).withColumns({"re": z.re, "im": z.im}).drop("w")
    power = maps.groupBy(*axes).agg(F.nullif(F.sum(cplx("s").abs2()), F.lit(0.0)).alias("_p"))
    out = adjoint(dense, maps, sizes, key).join(power, axes)
    return out.withColumns({c: F.col(c) / F.col("_p") for c in ("re", "im")}).drop("_p")


def tukey(i: Column, n: int, taper: float = 0.95) -> Column:
    """The window's value at place i of n: a flat top between cosine flanks that take the share `taper` of it, zero at both ends."""
    t = i / float(max(1, n - 1))
    edge = F.least(t, 1 - t)
    return F.when(edge >= taper / 2, F.lit(1.0)).otherwise(0.5 * (1 - F.cos(edge * (2 * math.pi / taper))))


def low_resolution_maps(samples: DataFrame, sizes: Sizes, weight: str | None = None, taper: float = 0.95, exponent: float = 3.0, key: str = "s", floor: float = 1e-5) -> DataFrame:
    """Coil maps (coil, mode..., sre, sim): density-weighted type 1, the image's transform times a Tukey window on each axis
    (raised to `exponent`), back, divided by the root of the sum of squares and its floor.

    samples: (coil, s, k<axis>, re, im) and the column `weight`.
    """
    from tensorloom.operators.reductions import rss

    axes = list(sizes)
    z = cplx().scale(F.col(weight)) if weight else cplx()
    plain = samples.withColumns({"re": z.re, "im": z.im}).drop(*[weight] * bool(weight))
    images = nufft1(plain, sizes, key).withColumns({a: (F.col(a) + n // 2).cast("int") for a, n in sizes.items()})
    f = fft_nd(samples.sparkSession, sizes)
    window = F.lit(1.0)
    for a, n in sizes.items():
        window = window * F.pow(tukey(F.col(a), n, taper), F.lit(exponent))
    smooth = checkpointed(f.H(f(images).withColumns({c: F.col(c) * window for c in ("re", "im")})).withColumns({a: F.col(a) - n // 2 for a, n in sizes.items()}))
    out = smooth.join(rss(smooth, *axes, floor=floor), axes)
    return out.select("coil", *axes, (F.col("re") / F.col("rss")).alias("sre"), (F.col("im") / F.col("rss")).alias("sim"))


def alternate_maps(samples: DataFrame, maps: DataFrame, freqs: DataFrame, sizes: Sizes, rounds: int, inner: int = 10, key: str = "s", radius: float = math.inf, decay: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(image, maps) from samples alone, in turns: the image by conjugate gradients on the maps' normal equations, then the
    maps as each coil's own image divided by the magnitude of that image.

    The coils' images are solved for once, all together, from samples that fade beyond `radius` (radians) of the centre.
    """
    from tensorloom.operators.prox import scaled
    from tensorloom.operators.selection import radius_decay
    from tensorloom.operators.solvers import conjugate_gradient

    axes = list(sizes)
    fade = radius_decay(F.sqrt(sum((F.col(f"k{a}") * F.col(f"k{a}") for a in axes), F.lit(0.0))), radius, decay) if math.isfinite(radius) else F.lit(1.0)
    right = checkpointed(nufft1(samples.withColumns({c: F.col(c) * fade for c in ("re", "im")}), sizes, key))
    coils = checkpointed(conjugate_gradient(lambda x: nufft_normal(x, freqs, sizes, key), right, scaled(right, 0.0), inner))
    image = None
    for _ in range(rounds):
        b = checkpointed(adjoint(samples, maps, sizes, key))
        image = conjugate_gradient(lambda x, m=maps: normal(x, m, freqs, sizes, key), b, scaled(b, 0.0) if image is None else image, inner)
        size = image.select(*axes, cplx().abs().alias("_m"))
        largest = size.agg(F.max("_m")).scalar()
        maps = checkpointed(coils.join(size, axes).select("coil", *axes, *[(F.col(c) / (F.col("_m") + largest * 1e-5)).alias(f"s{c}") for c in ("re", "im")]))
    return image, maps


def estimate_maps(samples: DataFrame, image: DataFrame, freqs: DataFrame, sizes: Sizes, rounds: int, lam: float, key: str = "s") -> DataFrame:
    """Coil maps (coil, mode..., sre, sim) that explain the samples of a known image: conjugate gradients on the regularised
    normal equations, all coils at once (they share no unknowns, so one step length serves a block-diagonal system)."""
    from tensorloom.operators.linop import plus, scale
    from tensorloom.operators.prox import scaled
    from tensorloom.operators.solvers import conjugate_gradient

    axes = list(sizes)
    known = image.select(*axes, F.col("re").alias("_re"), F.col("im").alias("_im"))
    z = cplx() * cplx("_").conj()
    b = checkpointed(nufft1(samples, sizes, key).join(known, axes).select("coil", *axes, z.re.alias("re"), z.im.alias("im")))

    def normal_of(x: DataFrame) -> DataFrame:
        maps = x.withColumnsRenamed({"re": "sre", "im": "sim"})
        return plus(coil_map_normal(maps, image, freqs, sizes, key), scale(lam)(x))

    return conjugate_gradient(normal_of, b, scaled(b, 0.0), rounds).withColumnsRenamed({"re": "sre", "im": "sim"})


def compress_coils(samples: DataFrame, target: int, key: str = "s", share: float = 1.0) -> DataFrame:
    """(coil, key, re, im) on the `target` strongest virtual coils.

    The coils' Gram matrix over a hash share of the samples is a join on the sample and a sum; it has coils x coils
    numbers, the only thing that reaches the driver, whose eigenvectors go back as a table of target x coils rows.
    """
    some = samples.where(F.pmod(F.xxhash64(key), F.lit(1000)) < int(1000 * share)) if share < 1 else samples
    right = some.select(key, F.col("coil").alias("_c"), F.col("re").alias("_re"), F.col("im").alias("_im"))
    z = cplx() * cplx("_").conj()
    rows = some.join(right, key).groupBy("coil", "_c").agg(F.sum(z.re).alias("re"), F.sum(z.im).alias("im")).collect()
    coils = sorted({r["coil"] for r in rows})
    if not coils:
        return samples.select("coil", key, "re", "im")
    gram = np.zeros((len(coils), len(coils)), complex)
    for r in rows:
        gram[coils.index(r["coil"]), coils.index(r["_c"])] = complex(r["re"], r["im"])
    vectors = np.linalg.eigh(gram)[1][:, ::-1][:, :target].conj().T
    table = [(k, c, float(v.real), float(v.imag)) for k, row in enumerate(vectors) for c, v in zip(coils, row, strict=True)]
    m = samples.sparkSession.createDataFrame(table, "_to int, coil int, mre double, mim double")
    p: Cplx = cplx("m") * cplx()
    return samples.join(F.broadcast(m), "coil").groupBy(F.col("_to").alias("coil"), key).agg(F.sum(p.re).alias("re"), F.sum(p.im).alias("im"))
