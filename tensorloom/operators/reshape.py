"""Stacking, flattening, resizing, tiling and blocks: index arithmetic on long-form tensors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.operators.ordering import positions


def stack(parts: list[DataFrame], name: str = "child") -> DataFrame:
    """Parts under a new leading index."""
    return reduce(DataFrame.unionByName, [p.withColumn(name, F.lit(k)) for k, p in enumerate(parts)])


def concat_frames(df: DataFrame, enc: str, frame: str, sample: str, name: str = "s") -> DataFrame:
    """The frames' samples one after the other, per encode."""
    return positions(df, (enc,), frame, sample, name=name)


def flatten_index(df: DataFrame, outer: str, inner: str, length: int, name: str) -> DataFrame:
    return df.withColumn(name, (F.col(outer) * length + F.col(inner)).cast("long")).drop(outer, inner)


def unflatten_index(df: DataFrame, name: str, length: int, outer: str, inner: str) -> DataFrame:
    return df.withColumns({outer: F.floor(F.col(name) / length).cast("long"), inner: F.pmod(name, F.lit(length)).cast("long")}).drop(name)


def resize_centre(df: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """Crops or pads about the centre: axis -> (size before, size after). Padding is not stored: absent rows are zero."""
    for axis, (old, new) in sizes.items():
        shift = max(old // 2 - new // 2, 0) - max(new // 2 - old // 2, 0)
        df = df.withColumn(axis, F.col(axis) - shift).where((F.col(axis) >= 0) & (F.col(axis) < new))
    return df


def dense(df: DataFrame, grid: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Every cell of the grid, absent ones as zero."""
    return grid.join(df, keys, "left").withColumns({v: F.coalesce(v, F.lit(0.0)) for v in values})


def sum_axes(df: DataFrame, keep: list[str], *values: str) -> DataFrame:
    return df.groupBy(*keep).agg(*[F.sum(v).alias(v) for v in values])


def tile(df: DataFrame, axis: str, n: int) -> DataFrame:
    """The adjoint of summing over an axis: the same values at each of its n places."""
    return df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def max_projection(df: DataFrame, keep: list[str], value: str) -> DataFrame:
    return df.groupBy(*keep).agg(F.max(value).alias(value))


def downsample(df: DataFrame, steps: dict[str, int]) -> DataFrame:
    for axis, d in steps.items():
        df = df.where(F.col(axis) % d == 0).withColumn(axis, F.floor(F.col(axis) / d).cast("int"))
    return df


def permute(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Axes exchanged: each axis takes the name that `names` gives it."""
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def zoom_linear(df: DataFrame, axis: str, old: int, new: int, value: str, *keys: str) -> DataFrame:
    """From `old` places to `new` ones with both ends kept, on the lines between neighbours.

    A new place j lies at j (old - 1) / (new - 1): each old place sends its share to the new places less than one away,
    and these are summed, so that nothing is compared and no series is held whole.
    """
    step = (old - 1) / max(1, new - 1)
    lo = F.greatest(F.lit(0), F.ceil((F.col(axis) - 1) / step)).cast("int")
    hi = F.least(F.lit(new - 1), F.floor((F.col(axis) + 1) / step)).cast("int")
    sent = df.select(*keys, F.explode(F.sequence(lo, hi)).alias("_to"), F.col(axis).alias("_at"), F.col(value).alias("_v"))
    part = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_to") * step - F.col("_at")))
    return sent.groupBy(*keys, F.col("_to").alias(axis)).agg(F.sum(F.col("_v") * part).alias(value))


def with_blocks(df: DataFrame, axes: tuple[str, ...], size: int, stride: int, shift: tuple[int, ...], extent: tuple[int, ...]) -> DataFrame:
    """Each cell with the block it is in (`block_<axis>`), for blocks at n stride + shift; null outside all blocks.

    A block whose end reaches the extent is skipped.
    """
    for a, s, n in zip(axes, shift, extent, strict=True):
        at = F.floor((F.col(a) - s) / stride).cast("int")
        inside = (F.col(a) >= s) & (F.col(a) - s - at * stride < size) & (at * stride + s + size < n)
        df = df.withColumn(f"block_{a}", F.when(inside, at))
    return df


def extract_block(df: DataFrame, corner: dict[str, int], size: int) -> DataFrame:
    for a, lo in corner.items():
        df = df.where((F.col(a) >= lo) & (F.col(a) < lo + size)).withColumn(a, F.col(a) - lo)
    return df


def insert_block(df: DataFrame, block: DataFrame, corner: dict[str, int], keys: list[str], *values: str) -> DataFrame:
    """The block's cells overwrite those of `df` at the corner."""
    for a, lo in corner.items():
        block = block.withColumn(a, F.col(a) + lo)
    new = block.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return df.join(new, keys, "left").withColumns({v: F.coalesce(f"_{v}", v) for v in values}).drop(*[f"_{v}" for v in values])


def packed_place(i: Column, j: Column) -> Column:
    """Where the lower triangle of a symmetric matrix holds (i, j): row by row."""
    lo, hi = F.least(i, j), F.greatest(i, j)
    return (hi * (hi + 1) / 2).cast("int") + lo


def unpack_symmetric(df: DataFrame, packed: str, n: int, *keep: str) -> DataFrame:
    """All (row, col, v) of a packed symmetric matrix."""
    cells = [F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"), F.get(F.col(packed), F.lit(max(i, j) * (max(i, j) + 1) // 2 + min(i, j))).alias("v")) for i in range(n) for j in range(n)]
    return df.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.row", "_c.col", "_c.v")
