"""Block low-rank thresholding: a block is a small matrix, decomposed where it is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions.cplx import cplx
from tensorloom.operators.reshape import with_blocks
from tensorloom.sources.storage import checkpointed


def _matrix(pdf: pd.DataFrame, rows: list[str], cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = pdf.groupby(rows, sort=True).ngroup().to_numpy()
    c = pdf.groupby(cols, sort=True).ngroup().to_numpy()
    m = np.zeros((r.max() + 1, c.max() + 1), complex)
    m[r, c] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    return m, r, c


def threshold(m: np.ndarray, amount: float, soft: bool) -> np.ndarray:
    """Singular values less `amount`, not below zero; or (hard) all but the first round(amount) set to zero."""
    u, s, v = np.linalg.svd(m, full_matrices=False)
    if soft:
        s = np.maximum(s - amount, 0)
    else:
        s[int(amount + 0.5) :] = 0
    return (u * s) @ v


def _thresholded(columns: list[str], rows: list[str], amount: float, soft: bool):
    """The function of one block's rows; all columns but `rows` and the values make the matrix's other side."""
    cols = [c for c in columns if c not in ("re", "im", *rows)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, r, c = _matrix(pdf, rows, cols)
        out = threshold(m, amount, soft)[r, c]
        return pdf[columns].assign(re=out.real, im=out.imag)

    return run


#: Cells of a block that one task turns into an R factor, on average, and R factors that are merged at a time.
QR_CELLS, QR_FAN = 1 << 18, 8


def r_factor(cube: DataFrame, block: list[str], rows: list[str]) -> DataFrame:
    """(block..., _r, other keys..., re, im): the R factor of each block as a matrix of `rows` by its other keys.

    A block's rows are dealt to as many parts as it takes for about QR_CELLS cells each; each part becomes an R factor where
    it is, and factors are merged QR_FAN at a time until one is left. So a block of any number of rows is spread over many
    tasks, a task holds a part or QR_FAN factors, and the condition number is not squared. The other side must fit a task.
    """
    cols = [c for c in cube.columns if c not in ("re", "im", *block, *rows)]
    kinds = ", ".join(f"`{c}` {cube.schema[c].dataType.simpleString()}" for c in (*block, *cols))
    most = cube.groupBy(*block).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // QR_CELLS))

    def reduced(keys: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            m, _, c = _matrix(pdf, keys, cols)
            r = np.linalg.qr(m, mode="r")
            names = pdf[cols].iloc[np.unique(c, return_index=True)[1]]
            out = names.iloc[np.tile(np.arange(len(names)), len(r))].reset_index(drop=True)
            out = out.assign(_part=pdf["_part"].iloc[0], _r=np.repeat(np.arange(len(r), dtype=np.int32), len(names)), re=r.real.ravel(), im=r.imag.ravel())
            return out.assign(**{b: pdf[b].iloc[0] for b in block})

        return run

    schema = f"{kinds}, _part int, _r int, re double, im double"
    dealt = cube.withColumn("_part", F.pmod(F.xxhash64(*rows), F.lit(parts)).cast("int"))
    r = dealt.groupBy(*block, "_part").applyInPandas(reduced(rows), schema)
    while parts > 1:
        parts = -(-parts // QR_FAN)
        merged = r.withColumns({"_from": F.col("_part"), "_part": F.floor(F.col("_part") / QR_FAN).cast("int")})
        r = merged.groupBy(*block, "_part").applyInPandas(reduced(["_from", "_r"]), schema)
    return r.select(*block, "_r", *cols, "re", "im")


def _tall(marked: DataFrame, columns: list[str], block: list[str], rows: list[str], amount: float, soft: bool) -> DataFrame:
    """`_thresholded` for any number of `rows`: no task holds a block, only factors of its other side.

    The R factor's right singular vectors make a small matrix for each block that the rows are multiplied by. Every row has
    all cells of its block.
    """
    cols = [c for c in columns if c not in ("re", "im", *rows)]
    to = [f"_to_{c}" for c in cols]
    factors = r_factor(marked.select(*block, *columns), block, rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, _, c = _matrix(pdf, ["_r"], cols)
        _, s, v = np.linalg.svd(m, full_matrices=False)
        if soft:
            keep = np.where(s > amount, 1 - amount / np.where(s > 0, s, 1), 0) if amount > 0 else np.ones(len(s))
        else:
            keep = (np.arange(len(s)) < int(amount + 0.5)).astype(float)
        w = (v.conj().T * keep) @ v
        names = pdf[cols].iloc[np.unique(c, return_index=True)[1]].reset_index(drop=True)
        n = len(names)
        left, right = names.iloc[np.repeat(np.arange(n), n)].reset_index(drop=True), names.iloc[np.tile(np.arange(n), n)].reset_index(drop=True)
        out = pd.concat([left, right.set_axis(to, axis=1)], axis=1).assign(mre=w.real.ravel(), mim=w.imag.ravel())
        return out.assign(**{b: pdf[b].iloc[0] for b in block})[[*block, *cols, *to, "mre", "mim"]]

    kind = lambda n, c: f"`{n}` {marked.schema[c].dataType.simpleString()}"
    kinds = ", ".join([kind(n, n) for n in (*block, *cols)] + [kind(t, c) for t, c in zip(to, cols, strict=True)])
    weights = factors.groupBy(*block).applyInPandas(run, f"{kinds}, mre double, mim double")
    e = cplx() * cplx("m")
    out = marked.join(weights, [*block, *cols]).groupBy(*block, *rows, *to).agg(F.sum(e.re).alias("re"), F.sum(e.im).alias("im"))
    return out.withColumnsRenamed(dict(zip(to, cols, strict=True))).select(*columns)


def svt_pass(cube: DataFrame, axes: tuple[str, ...], rows: list[str], size: int, stride: int, shift: tuple[int, ...], extent: tuple[int, ...], amount: float, soft: bool = True, tall: bool = False) -> DataFrame:
    """One pass over disjoint blocks: each is a matrix of `rows` by all its other keys. Cells in no block pass through.

    A block has size^axes cells for each of the other keys: one small group, or (tall) any number of `rows`.
    """
    if stride < size:
        raise ValueError("blocks of one pass must not overlap")
    block = [f"block_{a}" for a in axes]
    marked = with_blocks(cube, axes, size, stride, shift, extent)
    inside = F.lit(True)
    for b in block:
        inside = inside & F.col(b).isNotNull()

    if tall:
        done = _tall(marked.where(inside), cube.columns, block, rows, amount, soft)
    else:
        done = marked.where(inside).groupBy(*block).applyInPandas(_thresholded(cube.columns, rows, amount, soft), cube.schema)
    return done.unionByName(marked.where(~inside).select(*cube.columns))


def svt(cube: DataFrame, axes: tuple[str, ...], rows: list[str], extent: tuple[int, ...], size: int = 16, stride: int = 16, rounds: int = 4, amount: float = 0.01, soft: bool = True, seed: int = 0, tall: bool = False) -> DataFrame:
    """Several passes, the first unshifted, the later ones shifted by a seeded draw from 0 to the block size on each axis."""
    rng = np.random.default_rng(seed)
    for k in range(rounds):
        shift = tuple(int(x) for x in (rng.integers(0, size + 1, len(axes)) if k else np.zeros(len(axes))))
        cube = checkpointed(svt_pass(cube, axes, rows, size, stride, shift, extent, amount, soft, tall))
    return cube


def random_corners(spark, n: int, size: int, axes: tuple[str, ...], extent: tuple[int, ...], seed: int = 0) -> DataFrame:
    """(_block, corner...): n random blocks within the extent, in their order; they may overlap."""
    at = [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(e - size + 1)).cast("int").alias(a) for k, (a, e) in enumerate(zip(axes, extent, strict=True))]
    return spark.range(n).select(F.col("id").alias("_block"), *at)


def conflicts(corners: DataFrame, axes: tuple[str, ...], size: int) -> DataFrame:
    """(_block, _before): each block with the earlier ones that it overlaps.

    Corners are hashed to places as wide as a block. Two blocks overlap only if their places are neighbours, so one side goes
    to its neighbours, and an equal join on the place lists what is compared.
    """
    place = [F.floor(F.col(a) / size).cast("int").alias(f"_p{a}") for a in axes]
    near = corners.select("_block", *axes, *place)
    for a in axes:
        near = near.withColumn(f"_p{a}", F.explode(F.array(*[F.col(f"_p{a}") + d for d in (-1, 0, 1)])))
    earlier = corners.select(F.col("_block").alias("_before"), *[F.col(a).alias(f"_o{a}") for a in axes], *place)
    both = near.hint("merge").join(earlier, [f"_p{a}" for a in axes]).where("_before < _block")
    for a in axes:
        both = both.where(F.abs(F.col(a) - F.col(f"_o{a}")) < size)
    return both.select("_block", "_before")


def in_rounds(corners: DataFrame, axes: tuple[str, ...], size: int) -> DataFrame:
    """`corners` with _round: one more than the largest of the earlier blocks that a block overlaps, 0 if there are none.

    Blocks of a round are disjoint, and overlapping ones keep their order, so the rounds one after the other do what the blocks
    one by one would do. Each step settles the blocks all of whose earlier ones are settled: there are as many steps as
    rounds. What reaches the driver is a count.
    """
    edges = checkpointed(conflicts(corners, axes, size))
    settled = checkpointed(corners.join(edges.select("_block").distinct(), "_block", "left_anti").select("_block", F.lit(0).alias("_round")))
    number = 0
    while edges.count():
        number += 1
        last = settled.where(F.col("_round") == number - 1).select(F.col("_block").alias("_before"))
        done = edges.select("_block").distinct()
        edges = checkpointed(edges.join(last, "_before", "left_anti"))
        free = done.join(edges.select("_block").distinct(), "_block", "left_anti").select("_block", F.lit(number).alias("_round"))
        settled = checkpointed(settled.unionByName(free))
    return corners.join(settled, "_block")


def svt_at(cube: DataFrame, axes: tuple[str, ...], rows: list[str], corners: DataFrame, size: int, amount: float, soft: bool = True, tall: bool = False) -> DataFrame:
    """Thresholds the blocks at the corners (_block, axis...) in their order, each on what the earlier ones have left.

    Overlapping blocks come in rounds of disjoint ones (`in_rounds`), and each round's result is kept in the shared folder. In a
    round, each block lists its cells, which meet the cube's by an equal join.
    """
    ordered = checkpointed(in_rounds(corners, axes, size))
    last = ordered.agg(F.max("_round")).first()[0]
    for number in range(0 if last is None else last + 1):
        table = ordered.where(F.col("_round") == number).select("_block", *axes)
        for a in axes:
            table = table.withColumn(a, F.explode(F.sequence(F.col(a), F.col(a) + size - 1)))
        marked = cube.join(table.hint("merge"), list(axes), "left")
        inside = marked.where("_block is not null")
        done = _tall(inside, cube.columns, ["_block"], rows, amount, soft) if tall else inside.groupBy("_block").applyInPandas(_thresholded(cube.columns, rows, amount, soft), cube.schema)
        cube = checkpointed(done.unionByName(marked.where("_block is null").select(*cube.columns)))
    return cube


def singular_values(cube: DataFrame, block: str, rows: list[str]) -> DataFrame:
    """(block, rank, s) of each block as a matrix, from its R factor: a block may have any number of `rows`."""
    cols = [c for c in cube.columns if c not in ("re", "im", block, *rows)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.linalg.svd(_matrix(pdf, ["_r"], cols)[0], compute_uv=False)
        return pd.DataFrame({block: pdf[block].iloc[0], "rank": np.arange(len(s), dtype=np.int32), "s": s})

    return r_factor(cube, [block], rows).groupBy(block).applyInPandas(run, f"`{block}` {cube.schema[block].dataType.simpleString()}, rank int, s double")


def order_statistics(values: DataFrame) -> DataFrame:
    """Per rank over all blocks: least, lower median, largest and mean singular value."""
    return values.groupBy("rank").agg(F.min("s").alias("least"), F.expr("percentile_disc(0.5) within group (order by s)").alias("median"), F.max("s").alias("largest"), F.avg("s").alias("mean"))
