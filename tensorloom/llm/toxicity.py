"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import held_out, lower_ascii, ngram_hashes, slices, table, utf8, with_schema, word_hashes

#: Labelled rows to learn from at most (those with the smallest hashes of their ids).
MAX_ROWS = 16_000
#: Distinct features of all these rows at most (4 bytes each in the task that learns): rows after that are left out.
MAX_FEATURES = 1 << 25
#: Slots of the hashed features, and the score from which a document counts as toxic.
BITS = 20
THRESHOLD = 0.3
#: Word groups: single words, neighbours, and words two and three apart.
GROUPS = ((), (1,), (2,), (3,))

_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[[b for b in range(33, 128) if not chr(b).isalnum() and b not in b"'-*@$"]] = 32


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties; passes over a model's rows."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every word group of each text: words in lower case (A-Z), parted by white space and punctuation."""
    data, offsets = utf8(column)
    words, bounds = word_hashes(_BLANKED[lower_ascii(data)], offsets)
    parts = [ngram_hashes(words, bounds, steps, salt=101 * (k + 1)) for k, steps in enumerate(GROUPS)]
    slots = np.concatenate([h for h, _ in parts]) >> np.uint64(64 - BITS)
    return slots.astype(np.int64), np.concatenate([r for _, r in parts])


def fit(rows: list[np.ndarray], labels: np.ndarray, p: Ftrl = Ftrl()) -> np.ndarray:
    """Weights (the bias last) by FTRL-proximal over rows of distinct slots, in the order given."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.asarray([1 << BITS])

    def weights(i):
        return np.where(np.abs(z[i]) <= p.l1, 0.0, -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for slots, y in zip(rows, labels, strict=True):
            i = np.concatenate((slots, bias))
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(len(z)))


def distinct_features(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Each text's distinct slots, ascending."""
    slots, row = features(batch.column("text"))
    key = np.unique((row << BITS) | slots)
    return np.split((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key, np.arange(1, batch.num_rows) << BITS))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) learned from the labelled rows outside the held-out fold; the bias has slot 2 ** BITS.

    A bounded sample is learned from: the `max_rows` labelled ids with the smallest hashes, few enough to be broadcast, one
    row each (of rows that repeat an id, the one whose text has the smallest hash). Their features are made in many tasks;
    one task reads them as a stream, in the order of another hash, keeps them up to MAX_FEATURES and runs FTRL over them.
    Only weights that are not zero reach the driver. Null ids and labels teach nothing; a repeated label counts once, and
    1 beats 0. Without any such row the model is empty.
    """
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).where(F.col("doc_id").isNotNull()).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = distinct_features(batch)
            slots = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("y"), slots], names=["at", "y", "slots"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, y, held = [], [], 0
        for batch in batches:
            for slots, label in zip(batch.column("slots"), batch.column("y").to_pylist(), strict=True):
                held += len(slots.values)
                if held <= MAX_FEATURES:
                    found.append(slots.values.to_numpy().copy())
                    y.append(label)
        if found:
            w = fit(found, np.asarray(y, float))
            i = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w[i])], names=["slot", "w"])

    fitted = (
        rows.select(F.xxhash64(F.lit("order"), "doc_id").alias("at"), "y", "text")
        .mapInArrow(extract, "at long, y int, slots array<int>")
        .repartition(1)
        .sortWithinPartitions("at")
        .mapInArrow(learn, "slot long, w double")
        .toPandas()
    )
    return fitted["slot"].to_numpy(np.int64), fitted["w"].to_numpy(float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`docs` with `score` (0 to 1): the logistic of the bias and the weights of a text's distinct word groups.

    Null and empty texts get the bias alone; an empty model scores 0 (about 1e-15). All rows and columns of `docs` stay, but for one
    named score; `text` is needed. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("score")
    out = with_schema(docs, score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, w = shared.value
        dense = np.zeros((1 << BITS) + 1)
        dense[slots] = w
        bias, known = dense[-1] if len(slots) else -35.0, dense != 0
        for batch in slices(batches):
            slot, row = features(batch.column("text"))
            hit = known[slot]
            key = np.unique((row[hit] << BITS) | slot[hit])
            total = bias + np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


ORACLE = None
