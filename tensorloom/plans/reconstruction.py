"""The whole way from gated samples to images, frame by frame: every step is a DataFrame with the frame as a key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx
from tensorloom.operators import framed, gating, resample
from tensorloom.plans.shared import PI, Catalogue, complex_vectors, rounded, samples, signal, vectors
from tensorloom.sources.storage import checkpointed

C = Catalogue()


#: The axes of a vector's complex entries as a small volume, and the number of frames.
BOX = {"x": 4, "y": 4, "z": 2}
FRAMES = 3


def _inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(truth, maps, freqs, samples): gates of all events give each frame's samples, so frames are of unequal lengths; a frame's
    truth is the mean of the vectors dealt to it by their ids, as a volume, and each label's mean vector, plus one, is a coil."""
    at = [F.floor(F.col("i") / 8) - 2, F.floor(F.col("i") / 2) % 4 - 2, F.col("i") % 2 - 1]
    cells = [c.cast("int").alias(a) for a, c in zip(BOX, at, strict=True)]
    every = complex_vectors(spark, sf_dir).df.select("vec_id", "label", *cells, "re", "im")
    truth = checkpointed(every.groupBy(F.pmod("vec_id", F.lit(FRAMES)).cast("int").alias("frame"), *BOX).agg(F.avg("re").alias("re"), F.avg("im").alias("im")))
    maps = checkpointed(every.groupBy(F.col("label").alias("coil"), *BOX).agg((F.avg("re") + 1.0).alias("sre"), F.avg("im").alias("sim")))
    gated = gating.gate_by_value(signal(spark, sf_dir), "value", FRAMES)
    steps = (0.8191725134, 0.6710436067, 0.5497004779)  # fixed values: powers of the inverse of the root of x^4 = x + 1
    places = [((F.col("event_id") * s) % 1.0 * 2 * math.pi - math.pi).alias(f"k{a}") for a, s in zip(BOX, steps, strict=True)]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # else a small file keeps few cores busy
    freqs = checkpointed(gated.select("frame", F.col("event_id").alias("s"), *places).repartition(parts))
    return truth, maps, freqs, checkpointed(framed.forward(truth, maps, freqs, BOX))


def _errors(image: DataFrame, truth: DataFrame) -> DataFrame:
    """Relative error of each frame."""
    known = truth.select("frame", *BOX, F.col("re").alias("tre"), F.col("im").alias("tim"))
    error = image.join(known, ["frame", *BOX]).groupBy("frame").agg(F.sqrt(F.sum((cplx() - cplx("t")).abs2()) / F.sum(cplx("t").abs2())).alias("e"))
    return rounded(error, "frame", digits=2, relative_error=F.col("e"))


#: Of the nuclear norms of blocks, against the data term: the threshold of one step.
WEIGHT = 1e-4


@C.query()
def framed_reconstruction(spark, sf_dir):
    """Gate, sample, reconstruct all frames with a local low-rank prior: errors against the known truth; tested beside numpy."""
    truth, maps, freqs, samples = _inputs(spark, sf_dir)
    p = framed.problem(samples, maps, freqs, BOX)
    return _errors(framed.descend(p, framed.local_low_rank(WEIGHT * p.bound, BOX, 2)), truth)


@C.query()
def framed_primal_dual(spark, sf_dir):
    """The same by the primal-dual form."""
    truth, maps, freqs, samples = _inputs(spark, sf_dir)
    p = framed.problem(samples, maps, freqs, BOX)
    return _errors(framed.primal_dual(p, framed.local_low_rank(WEIGHT * p.bound, BOX, 2)), truth)


@C.query()
def framed_alternating(spark, sf_dir):
    """The same by copies and duals of two tilings of blocks, with inner conjugate gradients; tested beside numpy."""
    truth, maps, freqs, samples = _inputs(spark, sf_dir)
    p = framed.problem(samples, maps, freqs, BOX)
    return _errors(framed.alternating(p, framed.tilings(WEIGHT * p.bound, BOX, 2), 0.05 * p.bound), truth)


@C.query()
def framed_gridding(spark, sf_dir):
    """All frames by density weights and gridding alone; tested beside numpy."""
    truth, maps, freqs, samples = _inputs(spark, sf_dir)
    return _errors(framed.gridded(samples, maps, freqs, BOX), truth)


#: A label's mean vector as a small velocity image: four channels of 4 x 4 voxels.
SLICE = {"x": 4, "y": 4}


def resampling_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, maps, coordinates): labels are frames, with one more between each two; line items are samples, orders are spokes."""
    at = {"x": F.floor(F.col("i") / 4) % 4, "y": F.col("i") % 4}
    cells = vectors(spark, sf_dir).df.groupBy(F.col("label").alias("frame"), *[c.cast("int").alias(a) for a, c in at.items()], F.floor(F.col("i") / 16).alias("channel"))
    images = cells.agg(F.avg("re").alias("v")).groupBy("frame", *SLICE).agg(*[F.max(F.when(F.col("channel") == k, F.col("v"))).alias(c) for k, c in enumerate(resample.CHANNELS)])
    grid = spark.range(32).select((F.col("id") % 2).cast("int").alias("coil"), (F.floor(F.col("id") / 2) % 4).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    maps = grid.withColumns({"re": 1 + F.col("coil") * F.col("x") / 4.0, "im": (F.col("y") - F.col("coil")) / 8.0})
    order = F.floor(F.col("s") / 8)
    cycles = [(F.col(f"k{a}") * (n / (2 * float(PI)))).alias(f"k{a}") for a, n in SLICE.items()]
    coords = samples(spark, sf_dir).select((order % 19).cast("int").alias("frame"), (order % 5).cast("int").alias("enc"), order.alias("spoke"), (F.col("s") % 8).alias("s"), *cycles)
    return images, maps, coords


@C.query()
def full_resampling(spark, sf_dir):
    """What two coils measure of the labels' mean images at all line items; tested against the direct sum in numpy."""
    images, maps, coords = resampling_inputs(spark, sf_dir)
    out = resample.full_resampling(images, maps, coords, SLICE, 0.5, between=1)
    return rounded(out, "frame", "coil", "enc", "spoke", "s", digits=6, kx=F.col("kx"), ky=F.col("ky"), re=F.col("re"), im=F.col("im"))
