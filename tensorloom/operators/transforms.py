"""Fourier and cosine transforms, non-uniform transforms, gridding and interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cis, cplx
from tensorloom.operators import direct, volumes
from tensorloom.operators.linop import Linop, contract, matrix

Sizes = dict[str, int]  # axis -> number of cells or modes; modes are centred: -(n // 2) .. n - n // 2 - 1


def dft_matrix(spark: SparkSession, n: int, sign: int = -1, centred: bool = False, ortho: bool = False) -> DataFrame:
    """(row, col, mre, mim) of the transform of length n, as a range; centred: both indices count from -(n // 2)."""
    off = n // 2 if centred else 0
    at = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    turns = F.pmod((F.col("row") - off) * (F.col("col") - off), F.lit(n))
    z = cis(turns * (sign * 2 * math.pi / n)).scale(1 / math.sqrt(n) if ortho else 1.0)
    return at.select("row", "col", z.re.alias("mre"), z.im.alias("mim"))


def fft(spark: SparkSession, n: int, centred: bool = True, ortho: bool = True) -> Linop:
    """The (centred, orthonormal) transform along i; its adjoint is its inverse where orthonormal."""
    return matrix(dft_matrix(spark, n, -1, centred, ortho))


#: Complex numbers that a task transforms at a time.
LINE_NUMBERS = 1 << 20


def fft_lines(x: DataFrame, axis: str, n: int, sign: int = -1, centred: bool = True, ortho: bool = True) -> DataFrame:
    """The transform along `axis` (0 .. n - 1; absent places are zero) of each line of (keys..., axis, re, im), in n log n.

    A line, which is what the other keys share, becomes one row of arrays; batches of rows are transformed in numpy, and
    the n results of each come back as rows. Not orthonormal: the plain sum in both directions.
    """
    keys = [c for c in x.columns if c not in (axis, "re", "im")]
    lines = x.groupBy(*keys).agg(F.collect_list(F.struct(F.col(axis).cast("int").alias("i"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))).alias("_line"))
    kinds = "".join(f"`{c}` {x.schema[c].dataType.simpleString()}, " for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, LINE_NUMBERS // n)):
                batch = whole.slice(at, max(1, LINE_NUMBERS // n))
                line = batch.column("_line")
                cells = line.flatten()
                row = np.repeat(np.arange(len(line)), pc.list_value_length(line).to_numpy(zero_copy_only=False))
                m = np.zeros((len(line), n), complex)
                m[row, cells.field("i").to_numpy()] = cells.field("re").to_numpy() + 1j * cells.field("im").to_numpy()
                m = np.fft.ifftshift(m, axes=1) if centred else m
                m = np.fft.fft(m, axis=1, norm="ortho" if ortho else "backward") if sign < 0 else np.fft.ifft(m, axis=1, norm="ortho" if ortho else "forward")
                m = np.fft.fftshift(m, axes=1) if centred else m
                ends = pa.array(np.arange(len(line) + 1) * n, pa.int32())
                arrays = [pa.ListArray.from_arrays(ends, pa.array(part.ravel())) for part in (m.real, m.imag)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *arrays], names=[*keys, "_re", "_im"])

    done = lines.mapInArrow(run, f"{kinds}_re array<double>, _im array<double>")
    return done.select(*keys, F.posexplode(F.arrays_zip("_re", "_im")).alias(axis, "_z")).select(*keys, axis, F.col("_z._re").alias("re"), F.col("_z._im").alias("im"))


def fft_nd(spark: SparkSession, sizes: Sizes, centred: bool = True, ortho: bool = True) -> Linop:
    """The transform along several index columns; its adjoint is its inverse where orthonormal.

    One axis goes line by line; two or three as blocks of arrays (`volumes`), which exchange one array a pair of blocks.
    """

    def through(sign: int):
        def run(x: DataFrame) -> DataFrame:
            if len(sizes) == 1:
                ((axis, n),) = sizes.items()
                return fft_lines(x, axis, n, sign, centred, ortho).select(*x.columns)
            boxes = volumes.transform(volumes.blocks(x, sizes), sizes, 0, sign, centred, ortho)
            return volumes.rows(boxes, sizes, 1).select(*x.columns)

        return run

    return Linop(through(-1), through(1))


def ifft(x: DataFrame, n: int, centred: bool = False) -> DataFrame:
    """The inverse of the plain transform."""
    y = contract(dft_matrix(x.sparkSession, n, 1, centred), x, "row", "col", *[c for c in x.columns if c not in ("i", "re", "im")])
    return y.withColumns({"re": F.col("re") / n, "im": F.col("im") / n})


def dct_matrix(spark: SparkSession, n: int, kind: int = 2) -> DataFrame:
    """Orthonormal DCT-II (row: frequency) or its inverse DCT-III."""
    at = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    k, j = ("row", "col") if kind == 2 else ("col", "row")
    norm = F.when(F.col(k) == 0, F.lit(math.sqrt(1 / n))).otherwise(F.lit(math.sqrt(2 / n)))
    return at.withColumns({"mre": norm * F.cos((2 * F.col(j) + 1) * F.col(k) * (math.pi / (2 * n))), "mim": F.lit(0.0)})


def dct(spark: SparkSession, n: int) -> Linop:
    """The orthonormal DCT-II along i; the adjoint is the DCT-III."""
    return matrix(dct_matrix(spark, n, 2))


def _phase(modes: tuple[str, ...], freqs: tuple[str, ...]) -> Column:
    return sum((F.col(m) * F.col(k) for m, k in zip(modes, freqs, strict=True)), F.lit(0.0))


def on_modes(df: DataFrame, sizes: Sizes) -> DataFrame:
    """Every row once for each mode of a fixed grid."""
    for axis, n in sizes.items():
        df = df.withColumn(axis, F.explode(F.sequence(F.lit(-(n // 2)), F.lit(n - n // 2 - 1))))
    return df


#: Rows of modes that are broadcast.
BROADCAST_MODES = 1 << 16


def counted_side(small: DataFrame) -> DataFrame:
    """The side that an exploded one meets: broadcast if it has few rows by count, else hashed after a shuffle of both."""
    return F.broadcast(small) if small.limit(BROADCAST_MODES + 1).count() <= BROADCAST_MODES else small.hint("shuffle_hash")


def nufft2(modes: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s", sign: int = -1) -> DataFrame:
    """Type 2: the modes' sum at each frequency, exactly; rows of one key are summed.

    Arrays of frequencies meet arrays of their batch's modes (`direct`). Columns that both sides have are batch keys; other columns of
    the modes (coils, say) are kept.
    """
    return direct.type2(modes, freqs, sizes, key, sign)


def nufft1(samples: DataFrame, sizes: Sizes, key: str = "s", sign: int = 1) -> DataFrame:
    """Type 1: each mode's sum over the samples (key, batch..., k<axis>, re, im), exactly; no join, and a task's sums come before the shuffle."""
    return direct.type1(samples, sizes, key, sign)


def nufft_normal(modes: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s", between=None) -> DataFrame:
    """Type 1 of type 2, with a change of the samples in between if wanted. Without one, no sample leaves its task."""
    if between is None and math.prod(sizes.values()) <= direct.MODES:
        return direct.normal(modes, freqs, sizes, key)
    same = [c for c in modes.columns if c in freqs.columns and c not in ("re", "im")]
    samples = nufft2(modes, freqs, sizes, key).join(freqs.select(key, *same, *[f"k{a}" for a in sizes]), [key, *same])
    return nufft1(between(samples) if between else samples, sizes, key)


def nufft_normal_adjoint(samples: DataFrame, freqs: DataFrame, sizes: Sizes, key: str = "s") -> DataFrame:
    """Type 2 of type 1."""
    return nufft2(nufft1(samples, sizes, key), freqs, sizes, key)


def toeplitz_kernel(freqs: DataFrame, n: int, weight: Column | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """(batch..., d, mre, mim): the sum over frequencies of w e^(i k d) for the differences d of modes, -(n - 1) .. n - 1."""
    w = F.lit(1.0) if weight is None else weight
    rows = freqs.select(*batch, F.col("kn").alias("kd"), w.alias("re"), F.lit(0.0).alias("im"))
    return direct.type1(rows, {"d": 2 * n - 1}).withColumnsRenamed({"re": "mre", "im": "mim"})


def toeplitz_normal(modes: DataFrame, kernel: DataFrame, n: int) -> DataFrame:
    """The normal operator as a convolution: a sum over the frequencies once, whatever the number of modes vectors.

    Columns that modes and kernel share are batch keys: each batch has its own kernel. On one axis, by products; on grids,
    `toeplitz_spectrum` and `toeplitz_apply` do the same with transforms.
    """
    return direct.convolved(modes, kernel, "n", n)


def toeplitz_lags(freqs: DataFrame, sizes: Sizes, weight: Column | None = None, oversampling: float = 2.0, width: float = 6.0, *batch: str) -> DataFrame:
    """(batch..., axis..., re, im) on the grid of twice the modes: the sum over frequencies of w e^(i k d) at the lags d from -n on
    each axis (at place 0) to n - 1, by the gridded type 1. Frequencies are (s, k<axis>, batch...) in radians."""
    double = {a: 2 * n for a, n in sizes.items()}
    w = F.lit(1.0) if weight is None else weight
    ones = freqs.select("s", *batch, *[(F.col(f"k{a}") * (n / (2 * math.pi))).alias(f"k{a}") for a, n in double.items()], (w * math.sqrt(math.prod(double.values()))).alias("re"), F.lit(0.0).alias("im"))
    return kb_nufft_adjoint(ones, double, oversampling, width)


def toeplitz_spectrum(freqs: DataFrame, sizes: Sizes, weight: Column | None = None, oversampling: float = 2.0, width: float = 6.0) -> DataFrame:
    """(batch..., axis..., mre, mim) on the grid of twice the modes: the transform of the sum over frequencies of w e^(i k d).

    Frequencies are (s, k<axis>, batch...) in radians. The lags d, -n .. n - 1 on each axis, come from the gridded type 1.
    """
    double = {a: 2 * n for a, n in sizes.items()}
    batch = [c for c in freqs.columns if c not in ("s", *[f"k{a}" for a in sizes])]
    lags = toeplitz_lags(freqs, sizes, weight, oversampling, width, *batch)
    return fft_nd(freqs.sparkSession, double, ortho=False)(lags).withColumnsRenamed({"re": "mre", "im": "mim"})


def toeplitz_blocks(spectrum: DataFrame, sizes: Sizes) -> DataFrame:
    """The spectrum as blocks of arrays, for many applications."""
    return volumes.blocks(spectrum.withColumnsRenamed({"mre": "re", "mim": "im"}), {a: 2 * n for a, n in sizes.items()}, side=1)


def toeplitz_apply(modes: DataFrame, spectrum: DataFrame, sizes: Sizes) -> DataFrame:
    """The normal operator on centred modes: pad to twice the size, transform, multiply, transform back, crop.

    Volumes stay blocks of arrays in between; the spectrum's blocks (made here, if it comes as rows) meet them by an equal
    join on the block.
    """
    double = {a: 2 * n for a, n in sizes.items()}
    padded = modes.withColumns({a: (F.col(a) + n).cast("int") for a, n in sizes.items()})
    kernel = spectrum if "_re" in spectrum.columns else toeplitz_blocks(spectrum, sizes)
    product = volumes.multiplied(volumes.transform(volumes.blocks(padded, double), double, 0), kernel, math.prod(double.values()))
    back = volumes.rows(volumes.transform(product, double, 1, sign=1), double, 0)
    for a, n in sizes.items():
        back = back.withColumn(a, F.col(a) - n).where((F.col(a) >= -(n // 2)) & (F.col(a) < n - n // 2))
    return back.select(*modes.columns)


# The published polynomial approximation of the modified Bessel function I0, below and above 3.75.
_I0_LOW = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
_I0_HIGH = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)


def _polynomial(t: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * t + F.lit(c)
    return out


def kaiser_bessel(x: Column, beta: float) -> Column:
    """I0(beta sqrt(1 - x^2)) for |x| <= 1, else 0."""
    y = F.lit(beta) * F.sqrt(F.greatest(F.lit(0.0), 1 - x * x))
    low = _polynomial((y / 3.75) * (y / 3.75), _I0_LOW)
    high = F.exp(y) / F.sqrt(F.greatest(y, F.lit(1e-9))) * _polynomial(F.lit(3.75) / F.greatest(y, F.lit(1e-9)), _I0_HIGH)
    return F.when(F.abs(x) > 1, F.lit(0.0)).when(y < 3.75, low).otherwise(high)


def kernel_shape(oversampling: float = 1.25, width: float = 4.0) -> float:
    """The usual beta for an oversampling and a kernel width."""
    return math.pi * math.sqrt((width / oversampling * (oversampling - 0.5)) ** 2 - 0.8)


def _kernel(x: np.ndarray, beta: float) -> np.ndarray:
    """`kaiser_bessel` in numpy."""
    y = beta * np.sqrt(np.maximum(0.0, 1 - x * x))
    tail = np.maximum(y, 1e-9)
    low = np.polynomial.polynomial.polyval((y / 3.75) ** 2, _I0_LOW)
    high = np.exp(y) / np.sqrt(tail) * np.polynomial.polynomial.polyval(3.75 / tail, _I0_HIGH)
    return np.where(np.abs(x) > 1, 0.0, np.where(y < 3.75, low, high))


def tiled(sizes: Sizes, width: float, beta: float) -> volumes.Tiles:
    return volumes.Tiles(sizes, width, beta, _kernel)


def gridding(samples: DataFrame, sizes: dict[str, int], width: float, beta: float, *batch: str, some: bool | None = None) -> DataFrame:
    """Scatter-add of samples (k<axis>, re, im) on a periodic grid by tiles; a real signal has im = 0.

    Rows without a coordinate have no place; a null value is zero. `some`: whether the batches are few (`volumes.few`), if known.
    """
    return volumes.scatter(samples, tiled(sizes, width, beta), *batch, some=some)


def interpolate(grid: DataFrame, coords: DataFrame, sizes: dict[str, int], width: float, beta: float, key: str = "s", unique: bool = False) -> DataFrame:
    """The adjoint of gridding: each sample's weighted sum of its cells, by tiles; absent cells are zero.

    Columns that both sides have are batch keys; others of the grid are kept. Rows of one key are summed (with `unique`, each
    row is a sample of its own), and rows without a coordinate give none.
    """
    return volumes.gather(volumes.blocks(grid, sizes), coords, tiled(sizes, width, beta), 0, key, unique)


def apodise(grid: DataFrame, sizes: dict[str, int], width: float, beta: float, oversampling: float = 1.25) -> DataFrame:
    """Divides out the kernel's transform: a / sinh(a) on each axis, a = sqrt(beta^2 - (pi width x / grid size)^2)."""
    factor = F.lit(1.0)
    for axis, n in sizes.items():
        a = F.sqrt(F.greatest(F.lit(1e-12), beta**2 - F.pow(math.pi * width * (F.col(axis) - n // 2) / math.ceil(oversampling * n), 2)))
        factor = factor * a / F.sinh(a)
    return grid.withColumns({"re": F.col("re") * factor, "im": F.col("im") * factor})


def _grids(sizes: Sizes | int, oversampling: float) -> tuple[Sizes, Sizes]:
    sizes = {"x": sizes} if isinstance(sizes, int) else sizes
    return sizes, {a: math.ceil(oversampling * n) for a, n in sizes.items()}


def _spectrum(modes: DataFrame, sizes: Sizes, grid: Sizes, width: float, beta: float, oversampling: float) -> DataFrame:
    """The modes, apodised and padded, as blocks of the grid's transform."""
    shaped = apodise(modes, sizes, width, beta, oversampling).withColumns({a: (F.col(a) - n // 2 + grid[a] // 2).cast("int") for a, n in sizes.items()})
    return volumes.transform(volumes.blocks(shaped, grid), grid, 0, ortho=False)


def _places(coords: DataFrame, sizes: Sizes, grid: Sizes) -> DataFrame:
    """Coordinates in cycles per field of view as places on the grid."""
    return coords.withColumns({f"k{a}": F.col(f"k{a}") * (grid[a] / n) + grid[a] // 2 for a, n in sizes.items()})


def _modes(cells: DataFrame, sizes: Sizes, grid: Sizes, width: float, beta: float, oversampling: float) -> DataFrame:
    """The modes, from 0, of the grid's transform back: cropped and apodised."""
    for a, n in sizes.items():
        cells = cells.withColumn(a, F.col(a) - grid[a] // 2 + n // 2).where((F.col(a) >= 0) & (F.col(a) < n))
    return apodise(cells, sizes, width, beta, oversampling)


def kb_nufft(modes: DataFrame, coords: DataFrame, sizes: Sizes | int, oversampling: float = 1.25, width: float = 4.0, key: str = "s", unique: bool = False, most: int | None = None) -> DataFrame:
    """Type 2 on a grid of one to three axes by a Kaiser-Bessel window: apodise, pad, transform, interpolate; divided by the root of the modes' number.

    Modes (axis from 0, re, im, batch...) are centred; coordinates k<axis> are in cycles per field of view, -n/2 .. n/2.
    A sample touches (width + 1)^axes cells, whatever the number of modes, in one numpy gather a tile. The relative error is about 1e-2 at 1.25 and 4
    (the usual choice), and below 1e-3 at 2 and 6. An int is the size of the axis x.
    With `unique`, each row of `coords` is a sample of its own; else rows of one key are summed. `most`: see `volumes.gather`.
    """
    sizes, grid = _grids(sizes, oversampling)
    beta = kernel_shape(oversampling, width)
    spectrum = _spectrum(modes, sizes, grid, width, beta, oversampling)
    norm = width ** len(sizes) * math.sqrt(math.prod(sizes.values()))
    return volumes.gather(spectrum, _places(coords, sizes, grid), tiled(grid, width, beta), 1, key, unique, most).withColumns({c: F.col(c) / norm for c in ("re", "im")})


def kb_nufft_adjoint(samples: DataFrame, sizes: Sizes | int, oversampling: float = 1.25, width: float = 4.0, key: str = "s", some: bool | None = None) -> DataFrame:
    """The adjoint of `kb_nufft`: grid, transform back, crop, apodise; samples are (s, k<axis>, re, im, batch...), the modes count from 0."""
    sizes, grid = _grids(sizes, oversampling)
    beta = kernel_shape(oversampling, width)
    ks = [f"k{a}" for a in sizes]
    batch = [c for c in samples.columns if c not in (key, *ks, "re", "im")]
    at = _places(samples, sizes, grid)
    cells = fft_nd(samples.sparkSession, grid, centred=True, ortho=False).H(gridding(at, grid, width, beta, *batch, some=some))
    norm = width ** len(sizes) * math.sqrt(math.prod(sizes.values()))
    return _modes(cells, sizes, grid, width, beta, oversampling).withColumns({c: F.col(c) / norm for c in ("re", "im")})


def kb_nufft_normal(modes: DataFrame, coords: DataFrame, sizes: Sizes | int, oversampling: float = 1.25, width: float = 4.0, key: str = "s") -> DataFrame:
    """The adjoint of the windowed transform of the modes. On small grids that are the batches' own, samples are read and written in one visit."""
    sizes, grid = _grids(sizes, oversampling)
    beta = kernel_shape(oversampling, width)
    tiles, batch = tiled(grid, width, beta), [c for c in modes.columns if c not in (*sizes, "re", "im")]
    spectrum = _spectrum(modes, sizes, grid, width, beta, oversampling)
    if volumes.owned(spectrum, coords, tiles) and volumes.plain(coords.schema[key].dataType):
        boxes, split = volumes.gather_scatter(spectrum, _places(coords, sizes, grid), tiles, key)
        cells = volumes.rows(volumes.transform(boxes, grid, 0, sign=1, ortho=False), grid, 1)
        norm = width ** (2 * len(sizes)) * math.prod(sizes.values())
        back = _modes(cells, sizes, grid, width, beta, oversampling).select(*batch, *sizes, *[(F.col(c) / norm).alias(c) for c in ("re", "im")])
        return back.groupBy(*batch, *sizes).agg(F.sum("re").alias("re"), F.sum("im").alias("im")) if split else back
    there = kb_nufft(modes, coords, sizes, oversampling, width, key)
    same = [c for c in there.columns if c in coords.columns and c not in ("re", "im")]
    return kb_nufft_adjoint(there.join(coords.select(*same, *[f"k{a}" for a in sizes]), same), sizes, oversampling, width, key)


#: Points, and targets, of one block of a direct sum, on average.
BLOCK_POINTS = 1 << 15

#: Chebyshev nodes of an interval on which no target turns by more than TURN radians to either side of the middle: the error is below 1e-14.
NODES, TURN = 32, 6.0


def condensed(points: DataFrame, turns: float) -> DataFrame:
    """(p, re, im): points that have the same sums at all frequencies up to `turns`, to rounding: NODES for each occupied interval.

    On an interval, e^(i w p) is its polynomial through the Chebyshev nodes; a point's value is dealt to the nodes by their
    Lagrange weights, and the nodes' values are summed, partially before the shuffle.
    """
    half = TURN / turns
    nodes = np.cos((2 * np.arange(NODES) + 1) * math.pi / (2 * NODES))
    sizes = np.sin((2 * np.arange(NODES) + 1) * math.pi / (2 * NODES)) * (-1.0) ** np.arange(NODES)
    array = "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, re, im = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "re", "im"))
            cell = np.floor(p / (2 * half)).astype(np.int64)
            off = (p - (2 * cell + 1) * half)[:, None] / half - nodes
            hit = off == 0
            weight = sizes / np.where(hit, 1.0, off)
            weight = np.where(hit.any(1)[:, None], hit, weight / weight.sum(1, keepdims=True))
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=cell[order[0]] - 1))
            sums = [np.add.reduceat(weight[order] * v[order, None], starts, axis=0) for v in (re, im)]
            ends = pa.array(np.arange(len(starts) + 1) * NODES, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(cell[order][starts]), *[pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in sums]], names=["cell", "_re", "_im"])

    parts = points.select("p", "re", "im").mapInArrow(run, f"cell long, _re {array}, _im {array}")
    sums = parts.select("cell", F.posexplode(F.arrays_zip("_re", "_im")).alias("_i", "_z")).groupBy("cell", "_i").agg(F.sum("_z._re").alias("re"), F.sum("_z._im").alias("im"))
    place = F.array(*[F.lit(float(x)) for x in nodes])[F.col("_i")]
    return sums.select(((2 * F.col("cell") + 1 + place) * half).alias("p"), "re", "im")


def direct_dft(points: DataFrame, targets: DataFrame, sign: int = 1, blocks: int | None = None) -> DataFrame:
    """Type 3: values at points p, summed at frequencies w with e^(i w p).

    All pairs are what it asks for. Where the points are many for the turns that the frequencies make over them, the
    points are first replaced by fewer that have the same sums (`condensed`). Points and targets are dealt to blocks; each pair
    of blocks is a group, whose products are made in numpy, and whose sums meet by target. Rows with a null have no part,
    and rows of one target are summed.
    """
    double = lambda df, *names: df.select(*[c for c in df.columns if c not in names], *[F.col(n).cast("double").alias(n) for n in names])
    points = double(points.select("p", "re", "im"), "p", "re", "im").dropna()
    targets = double(targets.select("t", "w"), "w")
    size = points.agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    widest = targets.agg(F.max(F.abs("w")).alias("w"), F.count("*").alias("n")).first()
    turns, count = float(widest["w"] or 0.0), size["n"]
    if count and 0 < turns < math.inf and max(abs(size["lo"]), abs(size["hi"])) < 1e15 / turns:
        fewer = NODES * (math.floor((size["hi"] - size["lo"]) * turns / (2 * TURN)) + 2)
        if fewer < count:
            points, count = condensed(points, turns), fewer
    mine = blocks or max(1, -(-count // BLOCK_POINTS))
    others = max(1, -(-widest["n"] // BLOCK_POINTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = points.withColumn("_b", F.pmod(F.xxhash64("p", "re", "im"), F.lit(mine)).cast("int")).withColumn("_a", every(others))
    asked = targets.withColumn("_a", F.pmod(F.xxhash64("t", "w"), F.lit(others)).cast("int")).withColumn("_b", every(mine))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p, re, im = (np.asarray(left.column(c)) for c in ("p", "re", "im"))
        w = right.column("w").to_numpy()
        value, z, step = np.zeros(len(w), complex), re + 1j * im, max(1, (1 << 20) // max(1, len(p)))
        for lo in range(0, len(w), step):
            value[lo : lo + step] = np.exp(1j * sign * np.outer(w[lo : lo + step], p)) @ z
        some = len(p) > 0
        return pa.table([right.column("t").slice(0, None if some else 0), *(pa.array(np.ascontiguousarray(v if some else v[:0])) for v in (value.real, value.imag))], names=["t", "re", "im"])

    kind = targets.schema["t"].dataType.simpleString()
    both = dealt.groupBy("_a", "_b").cogroup(asked.dropna(subset=["w"]).groupBy("_a", "_b")).applyInArrow(run, f"t {kind}, re double, im double")
    return both.groupBy("t").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def direct_dft_adjoint(values: DataFrame, targets: DataFrame, sign: int = 1, blocks: int | None = None) -> DataFrame:
    """From frequencies (w, re, im) back to points (t, w: the point) with e^(-i w p)."""
    return direct_dft(values.withColumnRenamed("w", "p"), targets, -sign, blocks)
