"""Nearest neighbours by cosine: score-aware (anisotropic) product quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, table

#: Vectors to fit the codebooks on at most (those with the smallest hashes of their ids).
MAX_ROWS = 8192
#: Vectors and queries in a block, on average: one task scans one block of codes for one block of queries.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048
#: Cells of the coarse partition at most (fewer for tables of fewer blocks): as many as the sample can place well.
MAX_CELLS = 256
#: Share of the sample's nearest neighbours that must lie in the cells that a query visits; this fixes their number.
CELL_RECALL = 0.99
#: Candidates of each block that are ranked exactly at first, per neighbour asked for.
RERANK = 20
#: What a bound is raised by, for the single-precision sums of the tables.
SLACK = 1e-4
#: Pairs of a query and a row that are ranked exactly at a time.
PAIRS = 65536


@dataclass(frozen=True)
class Codebooks:
    """`words[m]` are the 16 codewords of part m of a unit vector; parts have `width` dimensions (the last may be padded)."""

    words: np.ndarray  # parts x 16 x width
    eta: float

    def pad(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.words.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (one byte a part) that make |r|^2 + (eta - 1) (r . x)^2 small, r being the residual of x.

        The nearest codewords first; then part after part the best one given the others, as the parallel error couples
        the parts.
        """
        x = self.pad(unit)
        norms = (self.words**2).sum(axis=2)
        dots = np.einsum("npd,pcd->npc", x, self.words)  # codeword . part of x
        cost = norms[None] - 2 * dots  # squared error, less the part's own square
        codes = cost.argmin(axis=2)
        own = (x**2).sum(axis=2)
        rows = np.arange(len(x))
        parallel = (own - np.take_along_axis(dots, codes[:, :, None], 2)[:, :, 0]).sum(axis=1)  # r . x
        for _ in range(sweeps):
            for m in range(x.shape[1]):
                rest = parallel - (own[:, m] - dots[rows, m, codes[:, m]])
                with_each = rest[:, None] + own[:, m, None] - dots[:, m]
                codes[:, m] = (cost[:, m] + (self.eta - 1) * with_each**2).argmin(axis=1)
                parallel = with_each[rows, codes[:, m]]
        return codes.astype(np.uint8)


def fit(unit: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 6) -> Codebooks:
    """Codebooks for the anisotropic loss: codes by `Codebooks.encode`, codewords by weighted least squares, in turns.

    The weight of the parallel error is eta = (d - 1) T^2 / (1 - T^2) for scores above the threshold T.
    """
    n, d = unit.shape
    parts = -(-d // width)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(7)
    x = np.pad(unit, ((0, 0), (0, parts * width - d))).reshape(n, parts, width)
    pick = rng.choice(n, 16, replace=n < 16)
    words = x[pick].transpose(1, 0, 2) + rng.normal(scale=1e-3, size=(parts, 16, width))
    size = 16 * width
    for k in range(rounds):
        book = Codebooks(words, 1.0 if k < 3 else eta)
        codes = book.encode(unit)
        hot = np.zeros((n, parts, 16))
        np.put_along_axis(hot, codes[:, :, None].astype(np.int64), 1, 2)
        v = (hot[:, :, :, None] * x[:, :, None, :]).reshape(n, parts * size)  # x's parts in the slots of their codes
        counts = hot.sum(axis=0).reshape(-1)
        a = np.diag(np.repeat(counts, width) + 1e-6) + (book.eta - 1) * (v.T @ v)
        b = (v.sum(axis=0) + (book.eta - 1) * (v * (unit**2).sum(axis=1)[:, None]).sum(axis=0)) + 1e-6 * words.reshape(-1)
        words = np.linalg.solve(a, b).reshape(parts, 16, width)
    return Codebooks(words, eta)


def cells(unit: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n centres of unit length by spherical k-means; an empty cell takes the vector that is furthest from its own."""
    rng = np.random.default_rng(11)
    centres = unit[rng.choice(len(unit), n, replace=len(unit) < n)]
    for _ in range(rounds):
        score = unit @ centres.T
        own = score.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        empty = np.bincount(own, minlength=n) == 0
        sums[empty] = unit[np.argsort(score.max(axis=1), kind="stable")[: empty.sum()]]
        length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def probes(unit: np.ndarray, centres: np.ndarray, k: int = 5, asked: int = 1024) -> int:
    """How many cells, the nearest first, hold CELL_RECALL of the k nearest neighbours within the sample.

    The whole table is denser than the sample, so its neighbours are nearer and rather in the first cells. Where the
    vectors have no structure, this comes to nearly all cells, and the search to one of all pairs.
    """
    own = (unit @ centres.T).argmax(axis=1)
    places = []
    for at in range(0, min(asked, len(unit)), 128):
        part = unit[at : min(at + 128, asked)]
        score = part @ unit.T
        score[np.arange(len(part)), at + np.arange(len(part))] = -np.inf
        near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(unit) - 1)]
        place = np.argsort(np.argsort(-(part @ centres.T), axis=1, kind="stable"), axis=1)
        places.append(np.take_along_axis(place, own[near], 1).ravel())
    found = np.sort(np.concatenate(places))
    return int(found[min(len(found) - 1, int(np.ceil(CELL_RECALL * len(found))))]) + 1 if len(found) else len(centres)


@dataclass(frozen=True)
class Model:
    """What is broadcast: codebooks, the cells' centres, and the number of cells that a query visits."""

    book: Codebooks
    centres: np.ndarray
    probes: int


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part: no null, zero or non-finite vectors, of the commonest length. A repeated id has
    the smallest of its vectors (by their entries in order), so that reruns agree.

    Vectors of floats stay so while they are moved (the cosines are in double precision).
    """
    v = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (top["n"] if top else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def train(rows: DataFrame, count: int, max_rows: int = MAX_ROWS) -> Model | None:
    """Fits on a bounded sample, in one task; the codebooks (16 codewords for each pair of dimensions) and at most MAX_CELLS
    centres reach the driver. A table has one cell for each BLOCK_ROWS of its `count` rows."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_rows)
    n = max(1, min(MAX_CELLS, count // BLOCK_ROWS, max_rows // 32))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(np.stack(pdf.sort_values("vec_id")["v"].to_numpy()).astype(float))
        book, centres = fit(unit), cells(unit, n)
        return pd.DataFrame({"words": [book.words.tobytes()], "parts": [book.words.shape[0]], "width": [book.words.shape[2]], "eta": [book.eta], "centres": [centres.tobytes()], "probes": [probes(unit, centres)]})

    got = sample.groupBy().applyInPandas(run, "words binary, parts int, width int, eta double, centres binary, probes int").collect()
    if not got:
        return None
    (r,) = got
    return Model(Codebooks(np.frombuffer(r["words"]).reshape(r["parts"], 16, r["width"]), r["eta"]), np.frombuffer(r["centres"]).reshape(n, -1), r["probes"])


def residual(unit: np.ndarray, codes: np.ndarray, book: Codebooks) -> np.ndarray:
    """The norms of the unit vectors less their codewords: no table score is further from the exact cosine."""
    coded = book.words[np.arange(codes.shape[1]), codes]
    return np.sqrt(((book.pad(unit) - coded) ** 2).sum(axis=(1, 2)))


def index(rows: DataFrame, model: Model) -> DataFrame:
    """Each row with its code (two parts' four bits in a byte), the norm of its residual, its cell and the cells that it would visit as a query."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch, m = whole.slice(at, BLOCK_ROWS), shared.value
                unit = _unit(_matrix(batch.column("v")))
                codes = m.book.encode(unit)
                off = pa.array(residual(unit, codes, m.book))
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = codes[:, ::2] | codes[:, 1::2] << 4
                near = np.argsort(-(unit @ m.centres.T), axis=1, kind="stable")[:, : m.probes].astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([c.tobytes() for c in packed], pa.binary()), off, pa.array(near[:, 0].copy()), visits], names=[*batch.schema.names, "code", "off", "cell", "visits"]
                )

    return rows.mapInArrow(run, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, code binary, off double, cell int, visits array<int>")


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row; equal scores at the border go to the columns first in order."""
    k = min(k, score.shape[1])
    border = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    over = score > border
    tied = (score == border) & (np.cumsum(score == border, axis=1) <= k - over.sum(axis=1, keepdims=True))
    return np.nonzero(over | tied)[1].reshape(len(score), k)


def scan(codes: pd.DataFrame, queries: pd.DataFrame, book: Codebooks, k: int, rerank: int) -> pd.DataFrame:
    """The k nearest rows of a block for each of a block of queries, by exact cosine.

    The best `k * rerank` of the table scan are ranked first; with the k-th of their cosines, every row follows whose
    table score plus the norm of its residual reaches that, so that no nearer row is left out.

    Equal vectors have equal codes: of each vector a block keeps the k + 1 smallest ids, which are all that can be among
    the k nearest of a query that is one of them.
    """
    codes = codes.sort_values("vec_id").reset_index(drop=True)
    codes = codes.drop_duplicates("vec_id")
    v = np.stack(codes["v"].to_numpy()).astype(float)
    few = pd.Series([x.tobytes() for x in v], index=codes.index)
    keep = (few.groupby(few).cumcount() <= k).to_numpy()
    codes, v = codes[keep], v[keep]
    ids = codes["vec_id"].to_numpy()
    norm, off = np.sqrt((v**2).sum(axis=1)), codes["off"].to_numpy()
    packed = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(ids), -1)
    queries = queries.drop_duplicates("vec_id")
    found = []
    for at in range(0, len(queries), 64):
        part = queries.iloc[at : at + 64]
        q, qid = np.stack(part["v"].to_numpy()).astype(float), part["vec_id"].to_numpy()
        lut = np.einsum("npd,pcd->npc", book.pad(_unit(q)), book.words).astype(np.float32)
        lut = np.pad(lut, ((0, 0), (0, lut.shape[1] % 2), (0, 0)))
        pairs = (lut[:, 1::2, :, None] + lut[:, ::2, None, :]).reshape(len(q), packed.shape[1], 256)  # high and low four bits
        approx = np.zeros((len(q), len(ids)), np.float32)
        for m in range(packed.shape[1]):
            approx += pairs[:, m].take(packed[:, m], axis=1)
        approx[ids[None] == qid[:, None]] = -np.inf
        length = np.sqrt((q**2).sum(axis=1))
        top = _best(approx, k * rerank)
        first = np.einsum("qcd,qd->qc", v[top], q) / (norm[top] * length[:, None])
        first[ids[top] == qid[:, None]] = -np.inf
        kth = np.sort(first, axis=1)[:, -min(k, first.shape[1])]
        ask, row = np.nonzero((approx + off[None] >= kth[:, None] - SLACK) & np.isfinite(approx))
        exact = np.concatenate([np.einsum("pd,pd->p", v[row[i : i + PAIRS]], q[ask[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)] or [np.zeros(0)])
        exact = exact / (norm[row] * length[ask])
        order = np.lexsort((ids[row], -exact, ask))
        place = np.arange(len(order)) - np.searchsorted(ask[order], ask[order])
        order = order[place < k]
        found.append(pd.DataFrame({"query_id": qid[ask[order]], "vec_id": ids[row[order]], "score": exact[order]}))
    return pd.concat(found)


def nearest(vectors: DataFrame, is_query, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found of each row for which `is_query` holds.

    Every row is indexed, in the cell of its nearest centre; a query visits as many cells as the sample's neighbours need
    (see `probes`), so it meets the part of the table that is near it. A cell is cut into blocks of about BLOCK_ROWS by a
    hash of the id, its visitors into blocks of about BLOCK_QUERIES, and each pair of blocks is one group: the work is
    spread however full a cell is. A row moves once for each block of its cell's visitors. Nothing but the model is
    broadcast, and only the counts of at most MAX_CELLS cells reach the driver. A block gives its k nearest, exactly (see
    `scan`); the k nearest of those follow. A repeated id counts once; vectors that take no part are left out, as queries too.
    """
    rows = checkpointed(usable(vectors))
    model = train(rows, rows.count())
    if model is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    spark = vectors.sparkSession
    coded = checkpointed(index(rows, model))
    asked = coded.where(is_query).select("vec_id", "v", F.explode("visits").alias("cell"))
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    visitors = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("q_blocks"))
    plan = spark.createDataFrame(sizes.join(visitors, "cell").collect(), "cell int, blocks int, q_blocks int")  # a row a cell
    block, q_block = F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"), F.pmod(F.xxhash64(F.lit("query"), "vec_id"), "q_blocks").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    coded = coded.join(F.broadcast(plan), "cell").select("cell", block.alias("block"), every("q_blocks").alias("q_block"), "vec_id", "v", "code", "off")
    asked = asked.join(F.broadcast(plan), "cell").select(F.col("cell").alias("to_cell"), every("blocks").alias("to_block"), q_block.alias("from_block"), F.col("vec_id").alias("asked_id"), F.col("v").alias("asked_v"))
    shared = spark.sparkContext.broadcast(model.book)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return scan(left, right.rename(columns={"asked_id": "vec_id", "asked_v": "v"}), shared.value, k, rerank)

    found = coded.groupBy("cell", "block", "q_block").cogroup(asked.groupBy("to_cell", "to_block", "from_block")).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = None
