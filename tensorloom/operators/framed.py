"""Series of frames from samples of unequal numbers: the samples are gridded once, all else works on images in the shared folder.

Frames are keys in every step and are solved together; none is padded to another's length. The gradient is the Toeplitz
normal operator on the doubled grid of up to three axes, so a round costs transforms of the images, whatever the number of
samples. The low-rank prior works on small blocks of voxels over all frames, each block in a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx
from tensorloom.operators import prox, sense, solvers, transforms, volumes
from tensorloom.operators.blocks import svt_pass
from tensorloom.operators.linop import Linop, identity
from tensorloom.operators.transforms import Sizes
from tensorloom.sources.storage import checkpointed

OVERSAMPLING, WIDTH = 2.0, 6.0


def in_cycles(df: DataFrame, sizes: Sizes) -> DataFrame:
    """Coordinates in radians as cycles per field of view."""
    return df.withColumns({f"k{a}": F.col(f"k{a}") * (n / (2 * math.pi)) for a, n in sizes.items()})


def from_zero(x: DataFrame, sizes: Sizes, sign: int = 1) -> DataFrame:
    """Centred modes counted from 0; with sign -1 the other way."""
    return x.withColumns({a: (F.col(a) + sign * (n // 2)).cast("int") for a, n in sizes.items()})


def forward(image: DataFrame, maps: DataFrame, freqs: DataFrame, sizes: Sizes) -> DataFrame:
    """(frame, coil, s, k<axis>..., re, im): what coils measure of centred images (frame, axis..., re, im), by windows; a row of freqs is a sample."""
    seen = from_zero(sense.weighted(image, maps, sizes), sizes)
    same, ks = [c for c in image.columns if c in freqs.columns], [f"k{a}" for a in sizes]
    at = in_cycles(freqs.select(*same, *ks, F.struct("s", *ks).alias("_at")), sizes)
    values = prox.scaled(transforms.kb_nufft(seen, at, sizes, OVERSAMPLING, WIDTH, "_at", unique=True), math.sqrt(math.prod(sizes.values())))
    return values.select(*[c for c in values.columns if c not in ("_at", "re", "im")], *[F.col(f"_at.{c}").alias(c) for c in ("s", *ks)], "re", "im")


def adjoint(samples: DataFrame, maps: DataFrame, sizes: Sizes, frames: DataFrame | None = None) -> DataFrame:
    """The adjoint of `forward`, coils combined. `frames`: a row for each frame, if known; else the samples are read for them."""
    some = None if frames is None else volumes.few(frames.select("frame").crossJoin(maps.select("coil").distinct()))
    back = transforms.kb_nufft_adjoint(in_cycles(samples, sizes), sizes, OVERSAMPLING, WIDTH, some=some)
    return sense.combined(from_zero(prox.scaled(back, math.sqrt(math.prod(sizes.values()))), sizes, -1), maps, sizes)


@dataclass(frozen=True)
class Problem:
    """1/2 |A x - y|^2 of all frames, each divided by its number of samples: A^H A as a map, A^H y, and a bound of A^H A's largest eigenvalue over the frames."""

    normal: Callable[[DataFrame], DataFrame]
    start: DataFrame
    bound: float
    sizes: Sizes

    def gradient(self, x: DataFrame) -> DataFrame:
        return prox.combine(self.normal(x), self.start, 1.0, -1.0)


def problem(samples: DataFrame, maps: DataFrame, freqs: DataFrame, sizes: Sizes) -> Problem:
    """From samples (frame, coil, s, k<axis>..., re, im) and their coordinates (frame, s, k<axis>...) in radians.

    A frame's data term is divided by its number of samples, so that short and long frames settle at the same pace.

    The bound is 1.2 times what four rounds of power iteration on A^H y give, or, if that is less, the largest value of a
    frame's kernel spectrum times the coils' largest power: the Toeplitz operator is a part of a circulant one whose
    eigenvalues that spectrum has.
    """
    maps = checkpointed(maps)
    spectrum = transforms.toeplitz_spectrum(freqs.select("frame", "s", *[f"k{a}" for a in sizes]), sizes, oversampling=OVERSAMPLING, width=WIDTH)
    counts = checkpointed(freqs.groupBy("frame").agg(F.count("*").alias("_n")))
    shared = lambda df, *values: df.join(counts, "frame").withColumns({v: F.col(v) / F.col("_n") for v in values}).drop("_n")
    spectrum = checkpointed(shared(spectrum, "mre", "mim"))
    power = maps.groupBy(*sizes).agg(F.sum(cplx("s").abs2()).alias("p")).agg(F.max("p")).first()[0]
    bound = spectrum.agg(F.max(F.hypot("mre", "mim"))).first()[0] * power
    kernel = checkpointed(transforms.toeplitz_blocks(spectrum, sizes))
    normal = lambda x: sense.toeplitz_normal(x, maps, kernel, sizes)
    start = checkpointed(shared(adjoint(samples, maps, sizes, counts), "re", "im"))
    bound = min(bound, 1.2 * solvers.power_iteration(normal, start, 4)[0])
    return Problem(normal, start, bound, sizes)


def local_low_rank(lam: float, sizes: Sizes, size: int) -> prox.Prox:
    """Of lam times the nuclear norms of blocks of `size` voxels on each axis, over all frames.

    The blocks are shifted from call to call along the diagonal, so that no edge between blocks stays where it is; voxels
    outside of whole blocks pass. A group has one block: size^axes voxels of each frame.
    """
    calls = 0

    def run(x: DataFrame, alpha: float) -> DataFrame:
        nonlocal calls
        shift = tuple(min(calls % size, n % size + size - 1) for n in sizes.values())
        calls += 1
        done = svt_pass(from_zero(x, sizes), tuple(sizes), ["frame"], size, size, shift, tuple(n + 1 for n in sizes.values()), lam * alpha)
        return from_zero(done, sizes, -1)

    return run


def descend(p: Problem, regulariser: prox.Prox = prox.zero, rounds: int = 8, tol: float = 0.02) -> DataFrame:
    """(frame, axis..., re, im): accelerated descent with step 1 / bound, until the images move by `tol` of their norm."""
    step = 1 / p.bound
    return solvers.gradient_descent(p.gradient, checkpointed(prox.scaled(p.start, step)), step, rounds, regulariser, True, tol)


def primal_dual(p: Problem, regulariser: prox.Prox, rounds: int = 8, tol: float = 0.02, k: Linop = identity) -> DataFrame:
    """The same by a dual variable for the prior (of k x, |k| <= 1), whose prox is that of the conjugate; both live in the shared folder."""
    sigma = 0.1 * p.bound
    x = checkpointed(prox.scaled(p.start, 1 / p.bound))
    return solvers.primal_dual_gradient(p.gradient, k, prox.convex_conjugate(regulariser), x, prox.scaled(k(x), 0.0), 1 / (p.bound / 2 + sigma), sigma, rounds, tol)


def tilings(lam: float, sizes: Sizes, size: int) -> list[solvers.Term]:
    """Two terms of lam / 2 each: the nuclear norms of blocks of `size` voxels on each axis, over all frames, and of the blocks half a
    block further, so that an edge of one tiling is inside of the other. Unlike `local_low_rank` they stay where they are: a convex prior.
    """

    def at(shift: int) -> prox.Prox:
        extent = tuple(n + 1 for n in sizes.values())

        def run(x: DataFrame, alpha: float) -> DataFrame:
            return from_zero(svt_pass(from_zero(x, sizes), tuple(sizes), ["frame"], size, size, tuple(min(shift, n % size + size - 1) for n in sizes.values()), extent, lam / 2 * alpha), sizes, -1)

        return run

    return [solvers.Term(at(0)), solvers.Term(at(size // 2))]


def alternating(p: Problem, terms: list[solvers.Term], rho: float, rounds: int = 3, inner_rounds: int = 3, tol: float = 0.02) -> DataFrame:
    """(frame, axis..., re, im): the priors by copies of the images and duals, the data term by conjugate gradients with steps for each frame."""
    return solvers.consensus(p.normal, p.start, terms, ["frame"], rho, rounds, inner_rounds, tol)


def gridded(samples: DataFrame, maps: DataFrame, freqs: DataFrame, sizes: Sizes, rounds: int = 5) -> DataFrame:
    """(frame, axis..., re, im): weighted by density, gridded, combined and divided by the maps' power; no iteration over images.

    Each frame has density weights of its own, scaled so that they sum to 1: a constant image comes out as it is.
    """
    grid = {a: math.ceil(OVERSAMPLING * n) for a, n in sizes.items()}
    at = freqs.select("frame", "s", *[(F.col(f"k{a}") * (grid[a] / (2 * math.pi)) + grid[a] // 2).alias(f"k{a}") for a in sizes])
    w = sense.density_weights(at, grid, WIDTH, transforms.kernel_shape(OVERSAMPLING, WIDTH), rounds, "s", "frame")
    frames = checkpointed(w.groupBy("frame").agg(F.sum("w").alias("_all")))
    w = w.join(frames, "frame").select("frame", "s", (F.col("w") / F.col("_all")).alias("w"))
    dense = samples.join(w, ["frame", "s"]).withColumns({c: F.col(c) * F.col("w") for c in ("re", "im")}).drop("w")
    power = maps.groupBy(*sizes).agg(F.nullif(F.sum(cplx("s").abs2()), F.lit(0.0)).alias("_p"))
    out = adjoint(dense, maps, sizes, frames).join(power, list(sizes))
    return out.withColumns({c: F.col(c) / F.col("_p") for c in ("re", "im")}).drop("_p")
