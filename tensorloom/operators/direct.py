"""Direct non-uniform sums: the waves e^(i k n) are made in numpy where frequencies and modes meet, and never listed as rows.

A batch's frequencies travel as rows of arrays of about CHUNK each, its modes as one row of arrays for each MODES cells of
the grid, and both meet by an equal join on the batch. Grids are centred: -(n // 2) .. n - n // 2 - 1 on each axis.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.sources.storage import checkpointed

Sizes = dict[str, int]

#: Frequencies of a batch that travel as one row, about; a fuller batch is split by a hash of the key.
CHUNK = 1 << 13

#: Modes that travel as one row.
MODES = 1 << 12

#: Waves, sums or results that are held at once.
HELD = 1 << 19

#: Rows of modes that are broadcast.
BROADCAST_MODES = 1 << 16


def _axis(k: np.ndarray, first: int, n: int) -> np.ndarray:
    """e^(i k m) for m = first .. first + n - 1, as products of two tables of about the root of n."""
    fine = math.isqrt(max(1, n - 1)) + 1
    with np.errstate(invalid="ignore"):
        coarse, near = (np.exp(1j * np.outer(k, m)) for m in (first + fine * np.arange(-(-n // fine)), np.arange(fine)))
    return (coarse[:, :, None] * near[:, None, :]).reshape(len(k), coarse.shape[1] * fine)[:, :n]


def waves(ks: list[np.ndarray], sizes: Sizes, lo: int, hi: int) -> np.ndarray:
    """e^(i k n): a row a frequency, a column for each of the cells lo .. hi - 1 of the grid, its last axis running fastest."""
    shape = tuple(sizes.values())
    if len(shape) == 1:
        return _axis(ks[0], lo - shape[0] // 2, hi - lo)
    out = 1.0
    for k, n, at in zip(ks, shape, np.unravel_index(np.arange(lo, hi), shape), strict=True):
        out = out * _axis(k, -(n // 2), n)[:, at]
    return out


def _cell(sizes: Sizes) -> Column:
    out = F.lit(0).cast("long")
    for a, n in sizes.items():
        out = out * n + (F.col(a) + n // 2)
    return out


def on_axes(df: DataFrame, sizes: Sizes, *keys: str) -> DataFrame:
    """(keys..., axis..., re, im) from rows of arrays over the grid, absent sums left out."""
    cells = df.select(*keys, F.posexplode(F.arrays_zip("_re", "_im")).alias("_i", "_z"))
    at, step = {}, math.prod(sizes.values())
    for a, n in sizes.items():
        step //= n
        at[a] = (F.floor(F.col("_i") / step) % n - n // 2).cast("int")
    return cells.select(*keys, *[c.alias(a) for a, c in at.items()], F.col("_z._re").alias("re"), F.col("_z._im").alias("im"))


def _chunks(freqs: DataFrame, same: list[str], key: str, *values: str) -> tuple[DataFrame, bool]:
    """(same..., _part, _f: list of (key, values...)), and whether each batch is in one row. Rows of one key share a row."""
    own = freqs.select(key, *same, *values)
    count = F.ceil(F.count("*") / CHUNK).cast("int").alias("_parts")
    if same:
        full = checkpointed(own.groupBy(*same).agg(count).where("_parts > 1"))
        split = full.count()
        if split:
            full = F.broadcast(full) if split <= BROADCAST_MODES else full.hint("merge")
            own = own.join(full, same, "left")
        parts = F.coalesce("_parts", F.lit(1)) if split else F.lit(1)
    else:
        split = own.agg(count).first()["_parts"]
        parts = F.lit(max(1, split))
        split = split > 1
    part = F.pmod(F.xxhash64(key), parts).cast("int").alias("_part")
    item = F.struct(F.col(key).alias("_key"), *[F.col(v).cast("double").alias(f"_{v}") for v in values])
    return own.select(*same, part, item.alias("_f")).groupBy(*same, "_part").agg(F.collect_list("_f").alias("_f")), not split


def _lines(modes: DataFrame, batch: list[str], sizes: Sizes) -> DataFrame:
    """(batch..., _m, _x: list of (i, re, im)): the cells of the grid by blocks of MODES; cells with a null are left out of the sums."""
    inside = F.lit(True)
    for a, n in sizes.items():
        inside = inside & (F.col(a) >= -(n // 2)) & (F.col(a) < n - n // 2)
    known = F.col("re").isNotNull() & F.col("im").isNotNull()
    value = [F.when(known, F.col(c).cast("double")).otherwise(0.0).alias(c) for c in ("re", "im")]
    rows = modes.where(inside).withColumn("_c", _cell(sizes))
    item = F.struct((F.col("_c") % MODES).cast("int").alias("i"), *value)
    return rows.select(*batch, F.floor(F.col("_c") / MODES).cast("int").alias("_m"), item.alias("_x")).groupBy(*batch, "_m").agg(F.collect_list("_x").alias("_x"))


def few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_MODES + 1).count() <= BROADCAST_MODES


def _met(chunks: DataFrame, modes: DataFrame, same: list[str], batch: list[str], sizes: Sizes) -> DataFrame:
    """Each row of frequencies beside each row of modes of its batch."""
    blocks = -(-math.prod(sizes.values()) // MODES)
    lines = _lines(modes, batch, sizes)
    asked = chunks.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asked.join(F.broadcast(lines) if few(modes) else lines.hint("merge"), [*same, "_m"])


class _Row:
    """What one row of a met batch holds, as numpy views of the Arrow columns; waves are kept while the frequencies stay the same."""

    def __init__(self, sizes: Sizes, values: list[str], same: list[str], block: int):
        self.sizes, self.values, self.same, self.block = sizes, values, same, block
        self.last, self.made = None, None

    def each(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        f, x, total = batch.column("_f"), batch.column("_x"), math.prod(self.sizes.values())
        items, cells = f.values, x.values
        keys = items.field("_key")
        codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        columns = [items.field(f"_{v}").to_numpy(zero_copy_only=False) for v in self.values]
        i, re, im = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("i", "re", "im"))
        ends, stops = f.offsets.to_numpy(), x.offsets.to_numpy()
        names = list(zip(*[batch.column(c).to_pylist() for c in (*self.same, "_part", "_m")], strict=True))
        for r, name in enumerate(names):
            lo, hi = ends[r], ends[r + 1]
            at = slice(stops[r], stops[r + 1])
            first = name[-1] * self.block
            width = min(self.block, total - first)
            m = np.bincount(i[at], re[at], width) + 1j * np.bincount(i[at], im[at], width)
            yield r, name, lo, hi, codes[lo:hi], [c[lo:hi] for c in columns], first, m

    def waves(self, name: tuple, cut: slice, ks: list[np.ndarray], first: int, width: int) -> np.ndarray:
        whole = len(ks[0]) * width <= HELD
        if whole and self.last == name:
            return self.made
        made = waves([k[cut] for k in ks], self.sizes, first, first + width)
        self.last, self.made = (name, made) if whole else (None, None)
        return made


def _step(width: int) -> int:
    return max(1, HELD // width)


def _lists(values: list[np.ndarray]) -> list[pa.Array]:
    ends = pa.array(np.cumsum([0, *[len(v) for v in values]]), pa.int32())
    flat = np.concatenate(values)
    return [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(part))) for part in (flat.real, flat.imag)]


def _kinds(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def type2(modes: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s", sign: int = -1) -> DataFrame:
    """(batch..., key, re, im): the modes' sum at each frequency; rows of one key are summed. A null coordinate gives null."""
    ks = [f"k{a}" for a in sizes]
    same = [c for c in modes.columns if c in freqs.columns and c not in ("re", "im")]
    batch = [c for c in modes.columns if c not in (*sizes, "re", "im")]
    chunks, _ = _chunks(freqs, same, key, *ks)
    double = T.DoubleType()
    schema = T.StructType([*_kinds(modes, batch), *_kinds(freqs, [key]), T.StructField("re", double), T.StructField("im", double)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Row(sizes, ks, same, MODES)
        for whole in batches:
            keys, held, place, at, count = whole.column("_f").values.field("_key"), [], [], [], 0
            known, single = None, True

            def out():
                z = np.concatenate(held)
                copies = pa.array(np.repeat([r for r, _ in at], [n for _, n in at]), pa.int64())
                unknown = np.isnan(z.real)
                values = [pa.array(np.ascontiguousarray(part), mask=unknown) for part in (z.real, z.imag)]
                return pa.RecordBatch.from_arrays([*(whole.column(b).take(copies) for b in batch), keys.take(pa.array(np.concatenate(place), pa.int64())), *values], names=schema.names)

            for r, name, lo, hi, codes, k, first, m in rows.each(whole):
                y = np.empty(hi - lo, complex)
                for start in range(0, hi - lo, _step(len(m))):
                    cut = slice(start, start + _step(len(m)))
                    w = rows.waves(name, cut, k, first, len(m))
                    y[cut] = (w.conj() @ m) if sign < 0 else (w @ m)
                if known != name[:-1]:
                    known, single = name[:-1], len(np.unique(codes)) == len(codes)
                if not single:
                    _, index, inverse = np.unique(codes, return_index=True, return_inverse=True)
                    y = np.bincount(inverse, y.real) + 1j * np.bincount(inverse, y.imag)
                    place.append(lo + index)
                else:
                    place.append(np.arange(lo, hi))
                held.append(y)
                at.append((r, len(y)))
                count += len(y)
                if count >= HELD:
                    yield out()
                    held, place, at, count = [], [], [], 0
            if at:
                yield out()

    values = _met(chunks, modes, same, batch, sizes).mapInArrow(run, schema)
    if math.prod(sizes.values()) <= MODES:
        return values
    return values.groupBy(*batch, key).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def normal(modes: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s", data: tuple[str, str, str] | None = None) -> DataFrame:
    """(batch..., axis..., re, im): type 1 of type 2 on a grid of at most MODES cells, in one visit of each frequency.

    data: columns (re, im, weight) of the frequencies; what is measured there is taken off, and the rest times the weight.
    Frequencies with a null have no part.
    """
    ks, more = [f"k{a}" for a in sizes], list(data or ())
    same = [c for c in modes.columns if c in freqs.columns and c not in ("re", "im")]
    batch = [c for c in modes.columns if c not in (*sizes, "re", "im")]
    chunks, whole = _chunks(freqs.dropna(subset=[*ks, *more]), same, key, *ks, *more)
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*_kinds(modes, batch), T.StructField("_re", array), T.StructField("_im", array)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Row(sizes, [*ks, *more], same, MODES)
        for some in batches:
            held = []
            for _, name, lo, hi, _, values, first, m in rows.each(some):
                total, k, rest = np.zeros(len(m), complex), values[: len(ks)], values[len(ks) :]
                for start in range(0, hi - lo, _step(len(m))):
                    cut = slice(start, start + _step(len(m)))
                    w = rows.waves(name, cut, k, first, len(m))
                    y = w.conj() @ m
                    if rest:
                        y = (y - (rest[0][cut] + 1j * rest[1][cut])) * rest[2][cut]
                    total += y @ w
                held.append(total)
            if held:
                yield pa.RecordBatch.from_arrays([*(some.column(b) for b in batch), *_lists(held)], names=schema.names)

    found = on_axes(_met(chunks, modes, same, batch, sizes).mapInArrow(run, schema), sizes, *batch)
    return found if whole else found.groupBy(*batch, *sizes).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def type1(samples: DataFrame, sizes: Sizes, key: str = "s", sign: int = 1, near: tuple[str, ...] = ("coil",)) -> DataFrame:
    """(batch..., axis..., re, im): each mode's sum over the samples (key, batch..., k<axis>, re, im); rows with a null have no part.

    Samples are brought together by their batch first, unless its columns are all among `near`, of which there are few
    values; a task then holds the sums of as many batches as fit, and one array a task and batch meets the others.
    """
    ks, total = [f"k{a}" for a in sizes], math.prod(sizes.values())
    batch = [c for c in samples.columns if c not in (*ks, key, "re", "im")]
    own = samples.select(*batch, *[F.col(c).cast("double").alias(c) for c in (*ks, "re", "im")]).dropna(subset=[*ks, "re", "im"])
    if set(batch) - set(near):
        own = own.hint("rebalance", *batch).sortWithinPartitions(*batch)
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*_kinds(samples, batch), T.StructField("_re", array), T.StructField("_im", array)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def out():
            names = list(zip(*held, strict=True)) if batch else []
            keys = [pa.array(list(v), t) for v, t in zip(names, kinds, strict=True)]
            done = pa.RecordBatch.from_arrays([*keys, *_lists(list(held.values()))], names=schema.names)
            held.clear()
            return done

        for rows in batches:
            if not rows.num_rows:
                continue
            kinds = [rows.column(b).type for b in batch]
            code = np.zeros(rows.num_rows, np.int64)
            for b in batch:
                own = rows.column(b).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            columns = [rows.column(c).to_numpy(zero_copy_only=False)[order] for c in (*ks, "re", "im")]
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            firsts = pa.array(order[starts], pa.int64())
            names = list(zip(*[rows.column(b).take(firsts).to_pylist() for b in batch], strict=True)) if batch else [()]
            y = columns[-2] + 1j * columns[-1]
            step = _step(min(total, MODES))
            for lo in range(0, len(y), step):
                cut = slice(lo, min(lo + step, len(y)))
                own = np.arange(np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, cut.stop))
                edges = np.maximum(starts[own] - lo, 0)
                for first in range(0, total, MODES):
                    w = waves([k[cut] for k in columns[: len(ks)]], sizes, first, min(first + MODES, total))
                    w = w if sign > 0 else w.conj()
                    sums = (y[cut] @ w)[None] if len(own) == 1 else np.add.reduceat(w * y[cut, None], edges, axis=0)
                    for g, value in zip(own, sums, strict=True):
                        if names[g] not in held:
                            held[names[g]] = np.zeros(total, complex)
                        held[names[g]][first : first + value.size] += value
                if len(held) * total > HELD:
                    yield out()
        if held:
            yield out()

    return on_axes(own.mapInArrow(run, schema), sizes, *batch).groupBy(*batch, *sizes).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def convolved(modes: DataFrame, kernel: DataFrame, axis: str, n: int) -> DataFrame:
    """(batch..., axis, re, im): the sum over m of kernel (same..., d, mre, mim) at d = axis - m times the modes on one axis.

    Modes and kernels are rows of arrays that meet by the columns they share; absent places are zero.
    """
    batch = [c for c in modes.columns if c not in (axis, "re", "im")]
    same = [c for c in batch if c in kernel.columns]
    boxed = lambda df, keys, i, re, im, name: df.groupBy(*keys, F.lit(0).alias("_m")).agg(F.collect_list(F.struct(i.cast("int").alias("i"), F.col(re).alias("re"), F.col(im).alias("im"))).alias(name))
    x = boxed(modes.where((F.col(axis) >= -(n // 2)) & (F.col(axis) < n - n // 2)), batch, F.col(axis) + n // 2, "re", "im", "_x")
    inside = kernel.where(F.abs("d") < n)
    k = boxed(inside, same, F.col("d") + n - 1, "mre", "mim", "_k")
    both = x.join(F.broadcast(k) if few(kernel) else k.hint("merge"), [*same, "_m"])
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*_kinds(modes, batch), T.StructField("_re", array), T.StructField("_im", array)])
    lag = np.arange(n)[:, None] - np.arange(n)[None, :] + n - 1

    def filled(lists: pa.ListArray, width: int) -> np.ndarray:
        cells = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        place = row * width + cells.field("i").to_numpy(zero_copy_only=False)
        re, im = (np.bincount(place, np.nan_to_num(cells.field(c).to_numpy(zero_copy_only=False)), len(lists) * width) for c in ("re", "im"))
        return (re + 1j * im).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _step(n * n)):
                some = whole.slice(lo, _step(n * n))
                z = np.einsum("rnm,rm->rn", filled(some.column("_k"), 2 * n - 1)[:, lag], filled(some.column("_x"), n))
                yield pa.RecordBatch.from_arrays([*(some.column(b) for b in batch), *_lists(list(z))], names=schema.names)

    return on_axes(both.mapInArrow(run, schema), {axis: n}, *batch)
