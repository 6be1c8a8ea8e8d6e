"""New samples of a known series of velocity images: crop, frames between frames, encodes, coils, transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx
from tensorloom.operators import transforms, velocity

#: What a voxel of a velocity image holds.
CHANNELS = ("mag", "vx", "vy", "vz")


def crop(df: DataFrame, corner: dict[str, int], sizes: dict[str, int]) -> DataFrame:
    """The box of `sizes` at the corner, counted from 0."""
    for a, n in sizes.items():
        lo = corner.get(a, 0)
        df = df.where((F.col(a) >= lo) & (F.col(a) < lo + n)).withColumn(a, (F.col(a) - lo).cast("int"))
    return df


def frames_between(images: DataFrame, between: int, *keys: str, values: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Frame f becomes frame f (between + 1), with `between` frames on the line to the next one; the last stands alone.

    Each frame sends its share to the frames around it and these are summed, with partial sums first. A new frame that
    lacks one of its two neighbours (after the last frame, or beside a missing one) is left out.
    """
    step = between + 1
    near = F.explode(F.sequence(F.lit(-between), F.lit(between))) if between else F.lit(0)
    sent = images.select(*keys, "frame", *values, near.alias("_d"))
    part = 1 - F.abs("_d") / float(step)
    out = sent.groupBy(*keys, (F.col("frame") * step + F.col("_d")).cast("int").alias("frame")).agg(*[F.sum(F.col(v) * part).alias(v) for v in values], F.sum(part).alias("_share"))
    return out.where("_share > 1 - 1e-9").drop("_share")


def full_resampling(images: DataFrame, maps: DataFrame, coords: DataFrame, sizes: dict[str, int], venc: float, corner: dict[str, int] | None = None, between: int = 0, oversampling: float = 2.0, width: float = 6.0) -> DataFrame:
    """(frame, coil, enc, spoke, s, k<axis>..., re, im): what coils would measure of the images, at coordinates of one's own choice.

    images: (frame, axis..., mag, vx, vy, vz); maps: (coil, axis..., re, im); coords: (frame, enc, spoke, s, k<axis>...) in
    cycles per field of view of the box, each sample with the frame that its spoke is gated into, counted after the frames
    in between are added. Both grids are cropped to the box `sizes` at `corner`. Voxels that are absent or null count as
    zero, samples of a frame without an image give no row; a sample's coils are those of the maps. Samples are told apart by all their columns, and repeated rows are one sample. Each sample is seen by
    its own frame and encode only, so the work is samples x coils x window, and voxels x encodes x coils a frame.
    """
    axes = list(sizes)
    corner = corner or {}
    series = frames_between(crop(images, corner, sizes).na.drop(subset=["frame", *CHANNELS]), between, *axes)
    encoded = velocity.encode(series, venc, "frame", *axes)
    seen = crop(maps, corner, sizes).select("coil", *axes, F.col("re").alias("sre"), F.col("im").alias("sim"))
    z = cplx() * cplx("s")
    modes = encoded.join(seen, axes).select("frame", "enc", "coil", *axes, z.re.alias("re"), z.im.alias("im"))
    ks = [f"k{a}" for a in axes]
    at = coords.select("frame", "enc", F.struct("spoke", "s", *ks).alias("at"), *ks).distinct()
    out = transforms.kb_nufft(modes, at, sizes, oversampling, width, "at")
    return out.select("frame", "coil", "enc", "at.*", "re", "im")
