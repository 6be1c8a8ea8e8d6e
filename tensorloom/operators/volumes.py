"""Volumes as blocks of arrays: transforms that exchange sub-blocks, and windows over tiles with a halo.

A volume in long form (keys..., axis..., re, im) is cut along its first axis (side 0) or its second (side 1) into blocks of
at most BLOCK_CELLS cells, each one row of arrays: (keys..., _b, _re, _im). A volume that fits is one block. Between the two
sides, a block sends one array to each block of the other side. All axes count from 0; absent cells are zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.sources.storage import checkpointed

Sizes = dict[str, int]

#: Cells of a block, if a single plane has no more.
BLOCK_CELLS = 1 << 18

#: Cells of a tile's edge by the number of axes (a shorter axis is one tile).
TILE_EDGE = {1: 4096, 2: 128, 3: 24}

#: Samples of a tile that go through one group; a fuller tile is split.
TILE_SAMPLES = 1 << 16

#: Fuller tiles that are broadcast.
HOT_TILES = 1 << 16

#: Window weights that are held at once.
_WEIGHTS = 1 << 20

#: Cells of volumes that are filled, transformed or multiplied together, many to a step.
SMALL_CELLS, STEP_CELLS = 1 << 14, 1 << 20

#: Cells of a kernel that is broadcast to all volumes that share it.
BROADCAST_CELLS = 1 << 21

#: Cells of the maps that go to each group of small volumes, and cells that are transformed at once there.
MAP_CELLS, VISIT_CELLS = 1 << 18, 1 << 16

#: Cells of a grid whose windows are laid out whole, and values of such windows that are held at once.
WHOLE_CELLS, _WHOLE = 1 << 11, 1 << 21

#: Batches whose grids a task sums side by side, and cells of such grids that are broadcast to all samples.
WHOLE_BATCHES, BROADCAST_GRIDS = 1 << 9, 1 << 18

#: Samples, and cells of small grids of their own, of one group of batches, about.
GROUP_SAMPLES, GROUP_CELLS = 1 << 14, 1 << 20

_ARRAY = T.ArrayType(T.DoubleType())


def _shape(sizes: Sizes) -> tuple[int, int, int]:
    """Three axes, the missing ones of one cell. A volume of more than three is not cut along its first two: it is not supported."""
    if not 1 <= len(sizes) <= 3:
        raise ValueError("volumes have one to three axes")
    return tuple((*sizes.values(), 1, 1)[:3])


def thickness(sizes: Sizes) -> tuple[int, int]:
    """Planes of a block on either side."""
    shape, total = _shape(sizes), math.prod(sizes.values())
    if total <= BLOCK_CELLS or len(sizes) == 1:
        return shape[0], shape[1]
    return tuple(max(1, BLOCK_CELLS // (total // shape[side])) for side in (0, 1))


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _boxed(df: DataFrame, keys: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*_fields(df, *keys), *[T.StructField(n, t) for n, t in more], T.StructField("_re", _ARRAY), T.StructField("_im", _ARRAY)])


def _lists(values: list[np.ndarray]) -> list[pa.Array]:
    ends = pa.array(np.cumsum([0, *[v.size for v in values]]), pa.int32())
    flat = np.concatenate([v.ravel() for v in values]) if values else np.zeros(0, complex)
    return [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part, dtype=float))) for part in (flat.real, flat.imag)]


def _array(row_re: pa.ListScalar, row_im: pa.ListScalar) -> np.ndarray:
    return np.asarray(row_re.values) + 1j * np.asarray(row_im.values)


def _same(batch, keys: list[str], rows: list[int]) -> list[pa.Array]:
    return [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row at a time: each is a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _steps(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """As many rows at a time as have STEP_CELLS cells."""
    for batch in batches:
        for lo in range(0, batch.num_rows, max(1, STEP_CELLS // cells)):
            yield batch.slice(lo, max(1, STEP_CELLS // cells))


def _matrix(m: np.ndarray) -> list[pa.Array]:
    """A row of arrays for each row of a matrix."""
    ends = pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part).ravel())) for part in (m.real, m.imag)]


def _flat(batch: pa.RecordBatch, re: str = "_re", im: str = "_im") -> np.ndarray:
    return batch.column(re).flatten().to_numpy(zero_copy_only=False) + 1j * batch.column(im).flatten().to_numpy(zero_copy_only=False)


def _small_blocks(x: DataFrame, sizes: Sizes, keys: list[str]) -> DataFrame:
    """`blocks` of volumes of few cells: lists of cells, filled many volumes at a time."""
    total, place = math.prod(sizes.values()), F.lit(0).cast("long")
    inside = F.lit(True)
    for a, n in sizes.items():
        place, inside = place * n + F.col(a), inside & (F.col(a) >= 0) & (F.col(a) < n)
    cell = F.struct(place.cast("int").alias("i"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    lists = x.where(inside).groupBy(*keys, F.lit(0).alias("_b")).agg(F.collect_list(cell).alias("_cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, total):
            cells = batch.column("_cells")
            items, count = cells.flatten(), batch.num_rows
            at = np.repeat(np.arange(count), np.diff(cells.offsets.to_numpy())) * total + items.field("i").to_numpy(zero_copy_only=False)
            re, im = (np.bincount(at, np.nan_to_num(items.field(c).to_numpy(zero_copy_only=False)), count * total) for c in ("re", "im"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "_b")), *_matrix((re + 1j * im).reshape(count, total))], names=[*keys, "_b", "_re", "_im"])

    return lists.mapInArrow(run, _boxed(x, keys, ("_b", T.IntegerType())))


def blocks(x: DataFrame, sizes: Sizes, side: int = 0) -> DataFrame:
    """(keys..., _b, _re, _im) from rows (keys..., axis..., re, im)."""
    axes, shape = list(sizes), _shape(sizes)
    keys = [c for c in x.columns if c not in (*axes, "re", "im")]
    thick = thickness(sizes)[side]
    if keys and thick >= shape[side] and math.prod(shape) <= SMALL_CELLS:
        return _small_blocks(x, sizes, keys)
    cut = F.floor(F.col(axes[side]) / thick).cast("int") if side < len(axes) else F.lit(0)

    def run(group: pa.Table) -> pa.Table:
        at = [np.asarray(group.column(a)).astype(np.int64) if i < len(axes) else 0 for i, a in enumerate([*axes, "", ""][:3])]
        b = group.column("_b")[0].as_py()
        own = _extent(shape, side, thick, b)
        at[side] = at[side] - b * thick
        place = (at[0] * own[1] + at[1]) * own[2] + at[2]
        value = [np.bincount(place, np.nan_to_num(np.asarray(group.column(c), dtype=float)), math.prod(own)) for c in ("re", "im")]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in value]
        return pa.table([*[group.column(k).slice(0, 1) for k in keys], pa.array([b], pa.int32()), *arrays], names=[*keys, "_b", "_re", "_im"])

    return x.withColumn("_b", cut).groupBy(*keys, "_b").applyInArrow(run, _boxed(x, keys, ("_b", T.IntegerType())))


def _extent(shape: tuple[int, int, int], side: int, thick: int, b: int) -> tuple[int, int, int]:
    out = list(shape)
    out[side] = min(thick, shape[side] - b * thick)
    return tuple(out)


def rows(boxes: DataFrame, sizes: Sizes, side: int) -> DataFrame:
    """(keys..., axis..., re, im): every cell of the blocks."""
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    axes, shape, thick = list(sizes), _shape(sizes), thickness(sizes)[side]
    cell = boxes.select(*keys, "_b", F.posexplode(F.arrays_zip("_re", "_im")).alias("_i", "_z"))
    wide = [F.lit(n) for n in shape]
    if side < len(axes):
        wide[side] = F.least(F.lit(thick), F.lit(shape[side]) - F.col("_b") * thick)
    at = [F.floor(F.col("_i") / (wide[1] * wide[2])), F.floor(F.col("_i") / wide[2]) % wide[1], F.col("_i") % wide[2]]
    at[side] = at[side] + F.col("_b") * thick
    return cell.select(*keys, *[at[k].cast("int").alias(a) for k, a in enumerate(axes)], F.col("_z._re").alias("re"), F.col("_z._im").alias("im"))


def _fft(m: np.ndarray, axes: tuple[int, ...], sign: int, centred: bool, ortho: bool) -> np.ndarray:
    m = np.fft.ifftshift(m, axes=axes) if centred else m
    m = np.fft.fftn(m, axes=axes, norm="ortho" if ortho else "backward") if sign < 0 else np.fft.ifftn(m, axes=axes, norm="ortho" if ortho else "forward")
    return np.fft.fftshift(m, axes=axes) if centred else m


def transform(boxes: DataFrame, sizes: Sizes, side: int, sign: int = -1, centred: bool = True, ortho: bool = True) -> DataFrame:
    """The transform along all axes; the result lies on the other side.

    Within a block all axes but the cut one are whole: these are transformed, then each block sends one array to each
    block of the other side, where the last axis is transformed. A volume in one block sends nothing.
    """
    shape, thick = _shape(sizes), thickness(sizes)
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    schema = _boxed(boxes, keys, ("_b", T.IntegerType()))
    alone = thick[side] >= shape[side]
    first = tuple(k for k in range(3) if shape[k] > 1 and (alone or k != side))
    other = 1 - side
    parts = -(-shape[other] // thick[other])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches):
            b = batch.column("_b")[0].as_py()
            m = _array(batch.column("_re")[0], batch.column("_im")[0]).reshape(_extent(shape, side, thick[side], b))
            m = _fft(m, first, sign, centred, ortho) if first else m
            cuts = [m] if alone else [np.take(m, range(j * thick[other], min((j + 1) * thick[other], shape[other])), axis=other) for j in range(parts)]
            count = len(cuts)
            numbers = [pa.array([0], pa.int32())] if alone else [pa.array([b] * count, pa.int32()), pa.array(range(count), pa.int32())]
            yield pa.RecordBatch.from_arrays([*_same(batch, keys, [0] * count), *numbers, *_lists(cuts)], names=[*keys, *(["_b"] if alone else ["_from", "_b"]), "_re", "_im"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, math.prod(shape)):
            m = _fft(_flat(batch).reshape(-1, *shape), tuple(k + 1 for k in first), sign, centred, ortho) if first else _flat(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "_b")), *_matrix(m.reshape(batch.num_rows, -1))], names=[*keys, "_b", "_re", "_im"])

    if alone:
        return boxes.mapInArrow(together, schema)

    def there(group: pa.Table) -> pa.Table:
        b = group.column("_b")[0].as_py()
        own = _extent(shape, other, thick[other], b)
        m = np.zeros(own, complex)
        for f, re, im in zip(group.column("_from").to_pylist(), group.column("_re"), group.column("_im"), strict=True):
            lo, part = f * thick[side], list(own)
            part[side] = min(thick[side], shape[side] - lo)
            where = [slice(None)] * 3
            where[side] = slice(lo, lo + part[side])
            m[tuple(where)] = _array(re, im).reshape(part)
        m = _fft(m, (side,), sign, centred, ortho)
        return pa.table([*[group.column(k).slice(0, 1) for k in keys], pa.array([b], pa.int32()), *_lists([m])], names=[*keys, "_b", "_re", "_im"])

    sent = boxes.mapInArrow(here, _boxed(boxes, keys, ("_from", T.IntegerType()), ("_b", T.IntegerType())))
    return sent.groupBy(*keys, "_b").applyInArrow(there, schema)


def multiplied(boxes: DataFrame, other: DataFrame, cells: int = BROADCAST_CELLS + 1) -> DataFrame:
    """Cell by cell; `other`'s keys are among those of `boxes`, and its blocks are cut alike. Arrays meet, not cells.

    If `other` is one volume for all, of `cells` cells, up to BROADCAST_CELLS are broadcast: else all volumes of a block
    would meet it in one task.
    """
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    same = [c for c in other.columns if c in (*keys, "_b")]
    right = other.withColumnsRenamed({"_re": "_mre", "_im": "_mim"})
    both = boxes.join(F.broadcast(right) if same == ["_b"] and cells <= BROADCAST_CELLS else right, same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lo = 0
            while lo < whole.num_rows:
                size = max(1, len(whole.column("_re")[lo].values))
                batch = whole.slice(lo, max(1, STEP_CELLS // size))
                z = _flat(batch) * _flat(batch, "_mre", "_mim")
                offsets = batch.column("_re").offsets.to_numpy()
                ends = pa.array(offsets - offsets[0], pa.int32())
                arrays = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part))) for part in (z.real, z.imag)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "_b")), *arrays], names=[*keys, "_b", "_re", "_im"])
                lo += batch.num_rows

    return both.mapInArrow(run, _boxed(boxes, keys, ("_b", T.IntegerType())))


def convolvable(x: DataFrame, kernel: DataFrame, sizes: Sizes) -> bool:
    """Whether `convolved` can do these volumes: few cells, one kernel for all, and keys that Arrow tells apart as Spark does."""
    keys = [c for c in x.columns if c not in (*sizes, "re", "im")]
    small = math.prod(2 * n for n in sizes.values()) <= min(SMALL_CELLS, BLOCK_CELLS)
    return small and {*kernel.columns} == {"_b", "_re", "_im"} and all(plain(x.schema[c].dataType) for c in keys)


def _placed(x: DataFrame, sizes: Sizes) -> DataFrame:
    """The rows with _i, their cell on the grid of twice the sizes, in whose middle the centred axes lie; rows beside it go."""
    place, inside = F.lit(0), F.lit(True)
    for a, n in sizes.items():
        at = (F.col(a) + n).cast("int")
        place, inside = place * (2 * n) + at, inside & (at >= 0) & (at < 2 * n)
    return x.where(inside).withColumn("_i", place.cast("int"))


def convolved(x: DataFrame, maps: DataFrame, kernel: DataFrame, sizes: Sizes) -> DataFrame:
    """(keys..., axis..., re, im): the sum over the coils of conj(map) times the convolution of map times volume, on centred axes:
    padded to twice the size, transformed, times the kernel, back and cropped. For volumes that are `convolvable`.

    x: (keys..., axis..., re, im), maps: (coil, axis..., sre, sim), the kernel one block. Volumes go as cells to groups of about
    GROUP_SAMPLES cells, or GROUP_CELLS of padded arrays, and each group has a copy of the kernel and the maps: a volume's
    products with the maps never leave their step. Maps of more than MAP_CELLS are dealt to several groups, whose sums are summed.
    """
    axes, double = list(sizes), {a: 2 * n for a, n in sizes.items()}
    shape, total = _shape(double), math.prod(double.values())
    keys = [c for c in x.columns if c not in (*axes, "re", "im")]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int") if by else F.lit(0)

    known = F.col("sre").isNotNull() & F.col("sim").isNotNull()
    sums = [F.sum(F.when(known, F.col(f"s{c}")).cast("double")).alias(c) for c in ("re", "im")]
    cells = checkpointed(_placed(maps.where(F.col("coil").isNotNull()), sizes).groupBy("coil", "_i").agg(*sums))
    coils = cells.agg(F.count_distinct("coil").alias("n"), F.count("*").alias("cells")).first()
    shares = max(1, -(-coils["n"] * total // MAP_CELLS))
    own = _placed(x, sizes).select(*keys, "_i", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    groups = 1
    if keys:
        size = own.agg(F.count("*").alias("cells"), F.approx_count_distinct(F.xxhash64(*keys)).alias("n")).first()
        groups = max(1, -(-size["cells"] // max(GROUP_SAMPLES, total + coils["cells"] // shares)), -(-size["n"] * total // GROUP_CELLS))
    own = own.withColumn("_g", dealt(groups, *keys)).withColumn("_share", every(shares))
    lists = cells.groupBy("coil").agg(F.collect_list(F.struct(F.col("_i").alias("i"), "re", "im")).alias("_cells"))
    both = lists.select("_cells", *[F.lit(None).cast("array<double>").alias(c) for c in ("_re", "_im")], dealt(shares, "coil").alias("_share"))
    shared = both.unionByName(kernel.select("_re", "_im", every(shares).alias("_share")), allowMissingColumns=True).withColumn("_g", every(groups))

    turned = np.fft.ifftshift(np.arange(total).reshape(shape)).ravel()  # the cells in the order that a plain transform takes
    place, over = np.argsort(turned), tuple(k + 1 for k in range(3) if shape[k] > 1)
    middle = np.stack(np.meshgrid(*[np.arange(n - n // 2, 2 * n - n // 2) for n in sizes.values()], indexing="ij")).reshape(len(sizes), -1)
    crop = place[np.ravel_multi_index(tuple(middle), tuple(double.values()))]
    schema = T.StructType([*_fields(x, *keys), *[T.StructField(a, T.IntegerType()) for a in axes], T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.column("_cells").combine_chunks()
        lists, which = lists.filter(lists.is_valid()), np.flatnonzero(right.column("_re").is_valid().to_numpy())
        if not left.num_rows or not len(lists) or not len(which):
            return pa.table([pa.array([], f.type) for f in _arrow(schema)], names=schema.names)
        spectrum = _array(right.column("_re")[which[0]], right.column("_im")[which[0]])[turned].reshape(shape)

        # the maps, and where they have a row and a value
        items, count = lists.flatten(), len(lists)
        at = np.repeat(np.arange(count), np.diff(lists.offsets.to_numpy())), place[items.field("i").to_numpy()]
        real = items.field("re").is_valid().to_numpy(zero_copy_only=False)
        m, has, given = (np.zeros((count, total), kind) for kind in (complex, np.float32, np.float32))
        m.real[at], m.imag[at] = (np.where(real, items.field(c).to_numpy(zero_copy_only=False), 0) for c in ("re", "im"))
        has[at], given[at] = 1, real

        # the volumes, and where they have a row; a number with half a value is zero
        code = np.zeros(left.num_rows, np.int64)
        for c in keys:
            each = left.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(each.dictionary) + each.indices.to_numpy(), return_inverse=True)[1]
        first = np.unique(code, return_index=True)[1]
        at = code, place[left.column("_i").to_numpy()]
        re, im = (left.column(c).to_numpy() for c in ("re", "im"))
        half = np.isnan(re) | np.isnan(im)
        v, touched = np.empty((len(first), total), complex), np.zeros((len(first), total), np.float32)
        v.real, v.imag = (np.bincount(at[0] * total + at[1], np.where(half, 0, part), v.size).reshape(v.shape) for part in (re, im))
        touched[at] = 1

        meets, out = touched @ has.T > 0, np.zeros((len(first), len(crop)), complex)
        clean, back = np.isfinite(m).all() and np.isfinite(v).all(), m[:, crop].conj()
        wide = max(1, VISIT_CELLS // total)
        for lo in range(0, len(v), max(1, wide // count)):
            some = slice(lo, lo + max(1, wide // count))
            for c in range(0, count, wide):
                part = slice(c, c + wide)
                z = (v[some, None] * m[part]).reshape(-1, *shape)
                z = np.fft.ifftn(np.fft.fftn(z if clean else np.nan_to_num(z), axes=over) * spectrum, axes=over)
                z = z.reshape(-1, len(m[part]), total)[:, :, crop]
                out[some] += (z * (back[part] if clean else np.where(meets[some, part, None], back[part], 0))).sum(1)
        meets = meets.astype(np.float32)
        row, cell = np.nonzero(meets @ has[:, crop])
        none, out = (meets @ given[:, crop] == 0)[row, cell], out[row, cell]
        tags = [left.column(c).take(pa.array(first[row])) for c in keys]
        places = [pa.array((middle[k] - n)[cell], pa.int32()) for k, n in enumerate(sizes.values())]
        return pa.table([*tags, *places, *[pa.array(np.ascontiguousarray(part), mask=none) for part in (out.real, out.imag)]], names=schema.names)

    done = own.groupBy("_g", "_share").cogroup(shared.groupBy("_g", "_share")).applyInArrow(run, schema)
    return done.groupBy(*keys, *axes).agg(F.sum("re").alias("re"), F.sum("im").alias("im")) if shares > 1 else done


def power(boxes: DataFrame, *over: str) -> DataFrame:
    """|z|^2 cell by cell, summed over the volumes that differ in the keys `over` alone; the imaginary part is zero.

    A task adds up what it holds of a block before anything is sent; then one array a task and block meets the others.
    """
    keys = [c for c in boxes.columns if c not in (*over, "_b", "_re", "_im")]
    names = [*keys, "_b", "_re", "_im"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list[pa.Array], np.ndarray]] = {}

        def out():
            for own, total in held.values():
                yield pa.RecordBatch.from_arrays([*own, *_lists([total.astype(complex)])], names=names)
            held.clear()

        for batch in _each(batches):
            z = _array(batch.column("_re")[0], batch.column("_im")[0])
            own = [batch.column(k) for k in (*keys, "_b")]
            name = tuple(c[0].as_py() for c in own)
            if name not in held and len(held) * z.size >= 4 * BLOCK_CELLS:
                yield from out()
            own, total = held.get(name, (own, 0.0))
            held[name] = own, total + z.real**2 + z.imag**2
        yield from out()

    def whole(group: pa.Table) -> pa.Table:
        total = sum(np.asarray(row.values) for row in group.column("_re"))
        return pa.table([*[group.column(k).slice(0, 1) for k in (*keys, "_b")], *_lists([total.astype(complex)])], names=names)

    schema = _boxed(boxes, keys, ("_b", T.IntegerType()))
    return boxes.mapInArrow(part, schema).groupBy(*keys, "_b").applyInArrow(whole, schema)


class Tiles:
    """How a periodic grid is cut into tiles, each with a halo as wide as the window."""

    def __init__(self, sizes: Sizes, width: float, beta: float, kernel):
        self.sizes, self.axes, self.shape = sizes, list(sizes), _shape(sizes)
        self.width, self.beta, self.kernel = width, beta, kernel
        edge = TILE_EDGE[len(sizes)]
        self.edge = tuple(min(n, edge) for n in self.shape)
        self.count = tuple(-(-n // e) for n, e in zip(self.shape, self.edge, strict=True))
        self.window = tuple(int(width) + 1 if k < len(sizes) else 1 for k in range(3))

    def number(self):
        """A sample's tile: that of the first cell of its window."""
        out = F.lit(0).cast("long")
        for k, a in enumerate(self.axes):
            first = F.pmod(F.ceil(F.col(f"k{a}") - self.width / 2), F.lit(self.shape[k]))
            out = out * self.count[k] + F.floor(first / self.edge[k])
        return out

    def cells(self, tile: int) -> list[np.ndarray]:
        """The cells of each axis that the tile's samples can touch, in the order of its array."""
        out = []
        for k in (2, 1, 0):
            t = tile % self.count[k] if k < len(self.axes) else 0
            tile = tile // self.count[k] if k < len(self.axes) else tile
            own = min(self.edge[k], self.shape[k] - t * self.edge[k])
            out.append((t * self.edge[k] + np.arange(own + self.window[k] - 1)) % self.shape[k])
        return out[::-1]

    def weights(self, tile: int, ks: list[np.ndarray], long: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of each sample the places in the tile's array, and the window's weights there: a row a sample."""
        m = len(ks[0])
        place, weight = np.zeros((m, 1), np.int64), np.ones((m, 1))
        start = [c[0] for c in self.cells(tile)]
        for k in range(3):
            if k < len(ks):
                lo = np.ceil(ks[k] - self.width / 2)
                w = self.kernel((lo[:, None] + np.arange(self.window[k]) - ks[k][:, None]) / (self.width / 2), self.beta)
                at = (np.mod(lo, self.shape[k]).astype(np.int64) - start[k])[:, None] + np.arange(self.window[k])
            else:
                w, at = np.ones((m, 1)), np.zeros((m, 1), np.int64)
            place = (place[:, :, None] * long[k] + at[:, None, :]).reshape(m, -1)
            weight = (weight[:, :, None] * w[:, None, :]).reshape(m, -1)
        return place, weight

    def chunk(self) -> int:
        return max(1, _WEIGHTS // math.prod(self.window))

    def whole(self) -> bool:
        """Whether the windows are laid out on the whole grid: products of small matrices then do all samples of a step."""
        return math.prod(self.shape) <= WHOLE_CELLS

    def wide(self, ks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The windows on the whole grid, a row a sample: those of the first axis, and the products of those of the others."""
        out = []
        for k, n in enumerate(self.shape):
            w = np.zeros((len(ks[0]), n)) if k < len(ks) else np.ones((len(ks[0]), 1))
            if k < len(ks):
                lo, each = np.ceil(ks[k] - self.width / 2), np.arange(len(ks[0]))
                first = np.mod(lo, n).astype(np.int64)
                for j in range(self.window[k]):
                    w[each, (first + j) % n] += self.kernel((lo + j - ks[k]) / (self.width / 2), self.beta)
            out.append(w)
        return out[0], (out[1][:, :, None] * out[2][:, None, :]).reshape(len(ks[0]), -1)


def _dealt(samples: DataFrame, tiles: Tiles, batch: list[str]) -> tuple[DataFrame, DataFrame]:
    """The samples with _tile and _salt, and the fuller tiles (batch..., _tile, _parts); null and infinite coordinates go."""
    own = samples.where(_known(tiles)).withColumn("_tile", tiles.number())
    full = own.groupBy(*batch, "_tile").agg(F.ceil(F.count("*") / TILE_SAMPLES).cast("int").alias("_parts")).where("_parts > 1")
    full = checkpointed(full)
    small = full.count()
    salt = F.pmod(F.xxhash64(*[f"k{a}" for a in tiles.axes], F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    if not small:
        return own.withColumn("_salt", F.lit(0)), full
    return own.join(F.broadcast(full) if small <= HOT_TILES else full.hint("merge"), [*batch, "_tile"], "left").withColumn("_salt", salt).drop("_parts"), full


def few(batches: DataFrame) -> bool:
    """Whether a task can sum a small grid for each of these side by side."""
    return batches.distinct().limit(WHOLE_BATCHES + 1).count() <= WHOLE_BATCHES


def scatter(samples: DataFrame, tiles: Tiles, *batch: str, some: bool | None = None) -> DataFrame:
    """(batch..., axis..., re, im): the samples (k<axis>, re, im) times the window, summed on the periodic grid.

    Each sample goes to its tile once, a full tile's to several groups; a group sums in one array, and the arrays of
    neighbours and of parts are summed cell by cell. Cells that no window touches are absent. On a small grid (`Tiles.whole`)
    of few batches samples stay where they are: a task sums each batch's in one array, and the arrays are summed.
    `some` says whether the batches are few; else they are counted.
    """
    ks = [f"k{a}" for a in tiles.axes]
    if tiles.whole() and (not batch or (few(samples.select(*batch)) if some is None else some)):
        return _scattered_whole(samples, tiles, list(batch))
    own, _ = _dealt(samples.select(*batch, *ks, "re", "im"), tiles, list(batch))

    def run(group: pa.Table) -> pa.Table:
        tile = group.column("_tile")[0].as_py()
        cells = tiles.cells(tile)
        long = [len(c) for c in cells]
        at = [np.asarray(group.column(k), dtype=float) for k in ks]
        z = [np.nan_to_num(np.asarray(group.column(c), dtype=float)) for c in ("re", "im")]
        total = np.zeros((3, math.prod(long)))
        for lo in range(0, len(z[0]), tiles.chunk()):
            cut = slice(lo, lo + tiles.chunk())
            place, weight = tiles.weights(tile, [k[cut] for k in at], long)
            for out, value in zip(total, (z[0][cut], z[1][cut], None), strict=True):
                out += np.bincount(place.ravel(), (weight if value is None else weight * value[:, None]).ravel(), len(out))
        some = np.flatnonzero(total[2])
        where = np.unravel_index(some, long)
        names = [*batch, *tiles.axes, "re", "im"]
        values = [pa.array(cells[k][where[k]], pa.int32()) for k in range(len(tiles.axes))]
        return pa.table([*[group.column(b).slice(0, 1).take(pa.array(np.zeros(len(some), np.int64))) for b in batch], *values, pa.array(total[0][some]), pa.array(total[1][some])], names=names)

    schema = T.StructType([*_fields(samples, *batch), *[T.StructField(a, T.IntegerType()) for a in tiles.axes], T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    parts = own.groupBy(*batch, "_tile", "_salt").applyInArrow(run, schema)
    return parts.groupBy(*batch, *tiles.axes).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _known(tiles: Tiles):
    """Whether a sample has a place: null and infinite coordinates have none."""
    known = F.lit(True)
    for a in tiles.axes:
        known = known & F.col(f"k{a}").isNotNull() & ~F.isnan(F.col(f"k{a}").cast("double")) & (F.abs(F.col(f"k{a}")) < 1e15)
    return known


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[int, int]]:
    """Where runs of rows with equal values lie."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for n in names:
        codes = batch.column(n).dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change)
    return zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True)


def _scattered_whole(samples: DataFrame, tiles: Tiles, batch: list[str]) -> DataFrame:
    """`scatter` on a grid of few cells."""
    ks, cells = [f"k{a}" for a in tiles.axes], math.prod(tiles.shape)
    names = [*batch, "_some", "_re", "_im"]
    step = max(1, _WHOLE // cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list[pa.Array], np.ndarray]] = {}

        def out():
            for own, total in held.values():
                lists = [pa.ListArray.from_arrays(pa.array([0, cells], pa.int32()), pa.array(np.ascontiguousarray(v).ravel())) for v in (total[2], total[0], total[1])]
                yield pa.RecordBatch.from_arrays([*own, *lists], names=names)
            held.clear()

        for whole in batches:
            if batch:
                whole = whole.sort_by([(b, "ascending") for b in batch])
            for first, last in _runs(whole, batch):
                own = [whole.column(b).slice(first, 1) for b in batch]
                name = tuple(c[0].as_py() for c in own)
                if name not in held and len(held) * cells >= 4 * BLOCK_CELLS:
                    yield from out()
                total = held.setdefault(name, (own, np.zeros((3, *tiles.shape[:1], cells // tiles.shape[0]))))[1]
                for lo in range(first, last, step):
                    cut = whole.slice(lo, min(step, last - lo))
                    one, rest = tiles.wide([cut.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ks])
                    values = [np.nan_to_num(cut.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("re", "im")]
                    total[0] += one.T @ (rest * values[0][:, None])
                    if values[1].any():
                        total[1] += one.T @ (rest * values[1][:, None])
                    total[2] += one.T @ rest
        yield from out()

    kinds = [*_fields(samples, *batch), *[T.StructField(n, _ARRAY) for n in names[-3:]]]
    parts = samples.where(_known(tiles)).select(*batch, *[F.col(k).cast("double").alias(k) for k in ks], "re", "im").mapInArrow(run, T.StructType(kinds))
    cell = parts.select(*batch, F.posexplode(F.arrays_zip("_some", "_re", "_im")).alias("_i", "_z")).where("_z._some != 0")
    at, left = {}, cells
    for k, a in enumerate(tiles.axes):
        left //= tiles.shape[k]
        at[a] = (F.floor(F.col("_i") / left) % tiles.shape[k]).cast("int")
    sums = cell.groupBy(*batch, "_i").agg(F.sum("_z._re").alias("re"), F.sum("_z._im").alias("im"))
    return sums.select(*batch, *[c.alias(a) for a, c in at.items()], "re", "im")


def _pieces(boxes: DataFrame, tiles: Tiles, side: int) -> DataFrame:
    """(keys..., _tile, _at, _re, _im): what each block has of each tile with its halo; _at: the planes in the tile's array."""
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    thick = thickness(tiles.sizes)[side]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches):
            b = batch.column("_b")[0].as_py()
            m = _array(batch.column("_re")[0], batch.column("_im")[0]).reshape(_extent(tiles.shape, side, thick, b))
            for tile in range(math.prod(tiles.count)):
                cells = tiles.cells(tile)
                inside = np.flatnonzero((cells[side] >= b * thick) & (cells[side] < b * thick + m.shape[side]))
                if len(inside):
                    index = list(cells)
                    index[side] = cells[side][inside] - b * thick
                    at = pa.ListArray.from_arrays(pa.array([0, len(inside)], pa.int32()), pa.array(inside, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([tile], pa.int64()), at, *_lists([m[np.ix_(*index)]])], names=[*keys, "_tile", "_at", "_re", "_im"])

    return boxes.mapInArrow(run, _boxed(boxes, keys, ("_tile", T.LongType()), ("_at", T.ArrayType(T.IntegerType()))))


def gather(boxes: DataFrame, coords: DataFrame, tiles: Tiles, side: int, key: str = "s", unique: bool = False, most: int | None = None) -> DataFrame:
    """(keys..., key, re, im): each sample's weighted sum of its cells, for each volume that it meets; rows of one key are
    summed, unless each row is a sample of its own (`unique`): then no row is sent to another.

    A tile's cells travel as arrays, one from each block that it touches, and each sample goes to its tile once; both meet
    there. A full tile is split, and its cells are copied to each part. Columns that both sides have are batch keys; of
    volumes with other keys (coils, say) as many share a group as fit. Few small grids (`Tiles.whole`) are broadcast to the samples,
    those of several keys that all samples share are copied to groups of samples of their own, and those that are their batch's own
    meet its samples many batches to a group (`owned`). `most`: how many the samples are at most; else they are counted.
    """
    ks = [f"k{a}" for a in tiles.axes]
    if owned(boxes, coords, tiles):
        return _gathered_owned(boxes, coords, tiles, key, unique)
    if tiles.whole():
        boxes = checkpointed(boxes)
        if boxes.limit(BROADCAST_GRIDS + 1).count() * math.prod(tiles.shape) <= BROADCAST_GRIDS:
            kept = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
            if unique and kept and not any(c in coords.columns for c in kept):
                return _gathered_shared(boxes, coords, tiles, key, most)
            values = _gathered_whole(boxes, coords, tiles, key)
            return values if unique else values.groupBy(*kept, key).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    same, rest = [c for c in keys if c in coords.columns], [c for c in keys if c not in coords.columns]
    held = math.prod(e + w - 1 for e, w in zip(tiles.edge, tiles.window, strict=True))
    shares = -(-boxes.select(*rest).distinct().count() * held // (1 << 22)) if rest else 1
    own, full = _dealt(coords.select(key, *same, *ks), tiles, same)
    pieces = _pieces(boxes, tiles, side)
    if full.count():
        pieces = pieces.join(full, [*same, "_tile"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    else:
        pieces = pieces.withColumn("_salt", F.lit(0))
    if shares > 1:
        own = own.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        pieces = pieces.withColumn("_share", F.pmod(F.xxhash64(*rest), F.lit(shares)).cast("int"))
    group = [*same, "_tile", "_salt", *["_share"] * (shares > 1)]
    names = [*keys, key, "re", "im"]
    schema = T.StructType([*_fields(boxes, *keys), *_fields(coords, key), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    empty = lambda: pa.table([pa.array([], f.type) for f in _arrow(schema)], names=names)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty()
        tile = right.column("_tile")[0].as_py()
        cells = tiles.cells(tile)
        long = [len(c) for c in cells]
        volumes: dict[tuple, tuple[int, np.ndarray]] = {}
        for i, name in enumerate(zip(*[right.column(r).to_pylist() for r in rest], strict=True) if rest else [()] * right.num_rows):
            _, m = volumes.setdefault(name, (i, np.zeros(long, complex)))
            inside, part = np.asarray(right.column("_at")[i].values), list(long)
            part[side] = len(inside)
            where = [slice(None)] * 3
            where[side] = inside
            m[tuple(where)] = _array(right.column("_re")[i], right.column("_im")[i]).reshape(part)
        at = [np.asarray(left.column(k), dtype=float) for k in ks]
        n = left.num_rows
        values = np.empty((len(volumes), n), complex)
        for lo in range(0, n, tiles.chunk()):
            cut = slice(lo, lo + tiles.chunk())
            place, weight = tiles.weights(tile, [k[cut] for k in at], long)
            for v, (_, m) in enumerate(volumes.values()):
                values[v, cut] = (m.ravel()[place] * weight).sum(1)
        copies = pa.array(np.repeat([i for i, _ in volumes.values()], n), pa.int64())
        columns = [right.column(k).take(copies) for k in keys]
        tags = left.column(key).take(pa.array(np.tile(np.arange(n), len(volumes))))
        return pa.table([*columns, tags, pa.array(values.real.ravel()), pa.array(values.imag.ravel())], names=names)

    values = own.groupBy(*group).cogroup(pieces.groupBy(*group)).applyInArrow(run, schema)
    return values if unique else values.groupBy(*keys, key).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _read(tiles: Tiles, grids: list[pa.Array], at: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of a step of samples the first, their number, and (2 x grids, samples): each one's weighted sums of the grids' cells, real
    and imaginary. grids: lists of the cells' real and imaginary parts."""
    count = len(grids[0])
    m = np.stack([part.flatten().to_numpy(zero_copy_only=False).reshape(count, tiles.shape[0], -1) for part in grids])
    m = m.transpose(2, 0, 1, 3).reshape(tiles.shape[0], -1)
    step = max(1, _WHOLE // max(math.prod(tiles.shape), m.shape[1]))
    for lo in range(0, len(at[0]), step):
        one, beside = tiles.wide([k[lo : lo + step] for k in at])
        yield lo, len(one), np.einsum("nvj,nj->vn", (one @ m).reshape(len(one), 2 * count, -1), beside)


def _gathered_shared(boxes: DataFrame, coords: DataFrame, tiles: Tiles, key: str, most: int | None) -> DataFrame:
    """`gather` for few grids of few cells that all samples share, a row for each sample and grid: samples are dealt to groups of
    about TILE_SAMPLES, of fewer where the grids are many, and each group has a copy of the grids."""
    ks = [f"k{a}" for a in tiles.axes]
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    own = coords.where(_known(tiles)).select(key, *[F.col(k).cast("double").alias(k) for k in ks])
    size = max(1, min(TILE_SAMPLES, GROUP_CELLS // max(1, boxes.count())))
    groups = max(1, -(-(own.count() if most is None else most) // size))
    own = own.withColumn("_g", F.pmod(F.xxhash64(key, *ks), F.lit(groups)).cast("int"))
    copies = boxes.select(*keys, "_re", "_im", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
    schema = T.StructType([*_fields(boxes, *keys), *_fields(coords, key), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], f.type) for f in _arrow(schema)], names=schema.names)
        n, count = left.num_rows, right.num_rows
        z = np.empty((2, count, n))
        for lo, some, part in _read(tiles, [right.column(c).combine_chunks() for c in ("_re", "_im")], [left.column(k).to_numpy() for k in ks]):
            z[:, :, lo : lo + some] = part.reshape(2, count, some)
        grid = pa.array(np.repeat(np.arange(count), n))
        tags = left.column(key).take(pa.array(np.tile(np.arange(n), count)))
        return pa.table([*[right.column(c).take(grid) for c in keys], tags, *[pa.array(part.ravel()) for part in z]], names=schema.names)

    return own.groupBy("_g").cogroup(copies.groupBy("_g")).applyInArrow(run, schema)


def _gathered_whole(boxes: DataFrame, coords: DataFrame, tiles: Tiles, key: str) -> DataFrame:
    """`gather` for few grids of few cells, a row for each sample: samples become rows of arrays where they are, and meet all
    volumes of their batch there."""
    ks = [f"k{a}" for a in tiles.axes]
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    same, rest = [c for c in keys if c in coords.columns], [c for c in keys if c not in coords.columns]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if same:
                order = pa.compute.sort_indices(batch.select(same), sort_keys=[(c, "ascending") for c in same])
                batch = batch.take(order)
            runs = list(_runs(batch, same))
            ends = pa.array([first for first, _ in runs] + [batch.num_rows], pa.int32())
            if runs:
                starts = pa.array([first for first, _ in runs], pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(starts) for c in same], *[pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("_key", *ks)]], names=[*same, "_key", *ks])

    kind = coords.schema[key].dataType
    schema = T.StructType([*_fields(coords, *same), T.StructField("_key", T.ArrayType(kind)), *[T.StructField(k, _ARRAY) for k in ks]])
    rows = coords.where(_known(tiles)).select(*same, F.col(key).alias("_key"), *[F.col(k).cast("double").alias(k) for k in ks]).mapInArrow(packed, schema)
    volume = F.collect_list(F.struct(*rest, "_re", "_im")).alias("_volumes")
    here = boxes.groupBy(*[F.col(c).alias(f"_o_{c}") for c in same]).agg(volume)
    both = F.lit(True)
    for c in same:
        both = both & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    met = rows.join(F.broadcast(here), both).select(*same, "_key", *ks, "_volumes")
    names = [*keys, key, "re", "im"]
    out = T.StructType([*_fields(boxes, *keys), *_fields(coords, key), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches):
            held = batch.column("_volumes").flatten()
            count = len(held)
            tags = batch.column("_key").flatten()
            at = [batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in ks]
            for lo, n, z in _read(tiles, [held.field(c) for c in ("_re", "_im")], at):
                z = z.reshape(2, count * n)
                copies = pa.array(np.repeat(np.arange(count), n), pa.int64())
                columns = {c: batch.column(c).take(pa.array(np.zeros(count * n, np.int64))) for c in same}
                columns |= {c: held.field(c).take(copies) for c in rest}
                own = tags.slice(lo, n).take(pa.array(np.tile(np.arange(n), count)))
                yield pa.RecordBatch.from_arrays([*[columns[c] for c in keys], own, pa.array(z[0]), pa.array(z[1])], names=names)

    return met.mapInArrow(run, out)


def plain(kind: T.DataType) -> bool:
    """Whether Arrow tells values of this type apart as Spark does."""
    return isinstance(kind, T.IntegralType) or kind == T.StringType()


def owned(boxes: DataFrame, coords: DataFrame, tiles: Tiles) -> bool:
    """Whether the grids are small and each batch of samples has one of its own."""
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    kinds = [(boxes.schema[c].dataType, coords.schema[c].dataType) for c in keys if c in coords.columns]
    return tiles.whole() and 0 < len(keys) == len(kinds) and all(plain(one) and one == other for one, other in kinds)


def _together(boxes: DataFrame, coords: DataFrame, tiles: Tiles, key: str, run: Callable[[_Owned], pa.Table], schema: T.StructType) -> tuple[DataFrame, bool]:
    """What `run` makes of grids and the samples of their batches, many batches to a group, and whether a batch lies in several groups.

    Groups are as many as samples and cells need, and a batch goes to one by its hash. A fuller batch is split by a hash of
    the key, and its grid is copied to each part; rows of one key share a part.
    """
    ks = [f"k{a}" for a in tiles.axes]
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    boxes = checkpointed(boxes.select(*keys, "_re", "_im"))
    own = coords.where(_known(tiles)).select(*keys, F.col(key).alias("_key"), *[F.col(k).cast("double").alias(k) for k in ks])
    count = checkpointed(own.groupBy(*[F.col(c).alias(f"_o_{c}") for c in keys]).agg(F.count("*").alias("_n")))
    full = count.where(F.col("_n") > TILE_SAMPLES)
    sizes = count.agg(F.sum("_n").alias("n"), F.count_if(F.col("_n") > TILE_SAMPLES).alias("full")).first()
    groups = max(1, -(-(sizes["n"] or 0) // GROUP_SAMPLES), -(-boxes.count() * math.prod(tiles.shape) // GROUP_CELLS))
    part = F.lit(0)
    if sizes["full"]:
        both = F.lit(True)
        for c in keys:
            both = both & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        right = F.broadcast(full) if sizes["full"] <= HOT_TILES else full.hint("merge")
        parts = F.ceil(F.coalesce("_n", F.lit(1)) / TILE_SAMPLES).cast("int")
        own = own.join(right, both, "left").withColumn("_part", F.pmod(F.xxhash64("_key"), parts).cast("int"))
        boxes = boxes.join(right, both, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        part = F.col("_part")
    group = F.pmod(F.xxhash64(*keys, part), F.lit(groups)).cast("int").alias("_g")
    own, boxes = own.select(group, part.alias("_part"), *keys, "_key", *ks), boxes.select(group, part.alias("_part"), *keys, "_re", "_im")

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], f.type) for f in _arrow(schema)], names=schema.names)
        return run(_Owned(left, right, tiles, keys))

    return own.groupBy("_g").cogroup(boxes.groupBy("_g")).applyInArrow(each, schema), bool(sizes["full"])


class _Owned:
    """The samples of a group, sorted by their grids: all windows of a step are laid out at once, and each batch's meet its grid in one product."""

    def __init__(self, left: pa.Table, right: pa.Table, tiles: Tiles, keys: list[str]):
        n, code = left.num_rows, np.zeros(left.num_rows + right.num_rows, np.int64)
        for c in (*keys, "_part"):
            both = pa.concat_arrays([*left.column(c).chunks, *right.column(c).chunks]).dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(both.dictionary) + both.indices.to_numpy(), return_inverse=True)[1]
        grid = np.full(code.max() + 1, -1)
        grid[code[n:]] = np.arange(right.num_rows)
        place = grid[code[:n]]
        order = np.argsort(place, kind="stable")
        order = order[np.searchsorted(place[order], 0) :]
        has, self.row = np.unique(place[order], return_inverse=True)
        self.ends = np.searchsorted(self.row, np.arange(len(has) + 1))
        self.tiles, self.cells = tiles, math.prod(tiles.shape)
        self.names = [right.column(c).take(pa.array(has)).combine_chunks() for c in keys]
        self.tags = left.column("_key").take(pa.array(order)).combine_chunks()
        self.at = [left.column(f"k{a}").to_numpy()[order] for a in tiles.axes]
        m = [right.column(c).combine_chunks().flatten().to_numpy().reshape(right.num_rows, tiles.shape[0], -1)[has] for c in ("_re", "_im")]
        self.grids = np.concatenate(m, axis=2)
        self.last: tuple = (None, None)

    def steps(self) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray], list[tuple[int, slice]]]]:
        """Samples, their windows, and the grids among them, each with its samples' place in the step."""
        n, step = len(self.row), max(1, _WHOLE // self.cells)
        for lo in range(0, n, step):
            cut = slice(lo, min(lo + step, n))
            if self.last[0] != cut:
                self.last = cut, self.tiles.wide([k[cut] for k in self.at])
            rows = range(self.row[lo], self.row[cut.stop - 1] + 1)
            yield cut, self.last[1], [(r, slice(max(self.ends[r], lo) - lo, min(self.ends[r + 1], cut.stop) - lo)) for r in rows]

    def values(self) -> np.ndarray:
        """(2, samples): each sample's weighted sum of its grid's cells, real and imaginary."""
        out = np.empty((2, len(self.row)))
        for cut, (one, beside), rows in self.steps():
            held = np.empty((len(one), self.grids.shape[2]))
            for r, own in rows:
                np.matmul(one[own], self.grids[r], out=held[own])
            out[:, cut] = np.einsum("nvj,nj->vn", held.reshape(len(one), 2, -1), beside)
        return out

    def alike(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The first sample of each key of a batch, and which of these each sample is; None where all differ."""
        own = self.tags.dictionary_encode(null_encoding="encode")
        code = self.row * len(own.dictionary) + own.indices.to_numpy()
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        return None if len(first) == len(code) else (first, which)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """(grids, cells): the samples' values times their windows, summed on the grid of each batch."""
        total = np.zeros_like(self.grids)
        for cut, (one, beside), rows in self.steps():
            held = (values[:, cut].T[:, :, None] * beside[:, None, :]).reshape(len(one), -1)
            for r, own in rows:
                total[r] += one[own].T @ held[own]
        z = total.reshape(len(total), self.tiles.shape[0], 2, -1)
        return (z[:, :, 0] + 1j * z[:, :, 1]).reshape(len(total), -1)


def _gathered_owned(boxes: DataFrame, coords: DataFrame, tiles: Tiles, key: str, unique: bool) -> DataFrame:
    """`gather` for grids of few cells, one for each batch."""
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    names, here = [*keys, key, "re", "im"], plain(coords.schema[key].dataType)
    schema = T.StructType([*_fields(boxes, *keys), *_fields(coords, key), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def run(group: _Owned) -> pa.Table:
        z, row, tags = group.values(), group.row, group.tags
        same = group.alike() if here and not unique else None
        if same:
            z, row, tags = np.stack([np.bincount(same[1], v) for v in z]), row[same[0]], tags.take(pa.array(same[0]))
        return pa.table([*(k.take(pa.array(row)) for k in group.names), tags, *map(pa.array, z)], names=names)

    values, _ = _together(boxes, coords, tiles, key, run, schema)
    return values if unique or here else values.groupBy(*keys, key).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def gather_scatter(boxes: DataFrame, coords: DataFrame, tiles: Tiles, key: str = "s") -> tuple[DataFrame, bool]:
    """`scatter` of `gather`, where `owned` and for `plain` keys: (keys..., _b, _re, _im), and whether a batch has several rows
    that are to be summed.

    Each sample is read and written where it meets its grid, and goes no further. Rows of one key each have the key's sum;
    rows with a null key or batch have no part.
    """
    keys = [c for c in boxes.columns if c not in ("_b", "_re", "_im")]
    names = [*keys, "_b", "_re", "_im"]

    def run(group: _Owned) -> pa.Table:
        z, same = group.values(), group.alike()
        if same:
            z = np.stack([np.bincount(same[1], v)[same[1]] for v in z])
        total = group.sums(np.nan_to_num(z))
        return pa.table([*group.names, pa.array(np.zeros(len(total), np.int32)), *_matrix(total)], names=names)

    return _together(boxes, coords.dropna(subset=[*keys, key]), tiles, key, run, _boxed(boxes, keys, ("_b", T.IntegerType())))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
