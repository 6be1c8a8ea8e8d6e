"""Ranked lexical search: postings by shard, merged document by document through a heap, with a bounded heap of results."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import scratch, slices, table
from tensorloom.llm.terms import ALNUM, words

#: Bytes of text in a shard: its index is one row, of about a third of that.
SHARD_BYTES = 8 << 20

#: Bytes of item texts in a block of queries: what is broadcast at once, with the weights, is a few times that.
BLOCK_BYTES = 1 << 20

#: Documents returned for each item.
TOP = 20

INDEX = "doc_ids array<long>, lengths array<long>, n_docs long, n_words long, terms array<string>, dfs array<long>, starts array<long>, postings binary"


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the low ones first, the top bit set but in a number's last byte; and each one's bytes."""
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 9):
        size += numbers >= 1 << 7 * k
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[at[more] + k] = (numbers[more] >> 7 * k & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        has = first + k <= last
        out[has] |= (data[first[has] + k].astype(np.int64) & 127) << 7 * k
    return out


def shard(doc_ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """The index of a slice of documents as one row: postings hold (gap, occurrences) by documents in the order of doc_id."""
    order = pc.sort_indices(doc_ids, null_placement="at_end")
    found = words(texts.take(order), ALNUM)
    n_terms = len(found.vocabulary)
    rows = len(texts)
    pair, tf = np.unique(found.ids * rows + found.rows(), return_counts=True)
    term, doc = pair // max(rows, 1), pair % max(rows, 1)
    fresh = np.concatenate((term[:1] >= 0, term[1:] != term[:-1]))
    gap = doc - np.where(fresh, 0, np.concatenate(([0], doc[:-1])))
    data, size = packed(np.stack([gap, tf], 1).ravel())
    first = np.flatnonzero(fresh)
    starts = np.concatenate(([0], np.cumsum(np.add.reduceat(size.reshape(-1, 2).sum(1), first)))) if n_terms else np.zeros(1, np.int64)
    lengths = np.diff(found.bounds)
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind))
    return [
        one(doc_ids.take(order), pa.int64()),
        one(lengths, pa.int64()),
        pa.array([int((lengths > 0).sum())], pa.int64()),
        pa.array([int(lengths.sum())], pa.int64()),
        one(found.vocabulary, pa.string()),
        one(np.diff(np.append(first, len(pair))), pa.int64()),
        one(starts, pa.int64()),
        pa.array([data.tobytes()], pa.binary()),
    ]


def build_index(docs: DataFrame) -> DataFrame:
    """One row for each shard of at most 8 MB of texts, or one longer text, in the shared folder. Nothing is shuffled.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A shard has its doc_ids in ascending
    order (null last), their numbers of terms, and for each term the compressed list of (document, occurrences).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in INDEX.split(", ")]
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, limit=SHARD_BYTES):
            more = batch.column("text").nbytes
            if held and size + more > SHARD_BYTES:
                yield pa.RecordBatch.from_arrays(_shard_of(held), names=names)
                held, size = [], 0
            held.append(batch)
            size += more
        if held:
            yield pa.RecordBatch.from_arrays(_shard_of(held), names=names)

    path = scratch(docs.sparkSession, "index")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX).write.parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def _shard_of(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    whole = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name, kind: pa.concat_arrays(whole.column(name).chunks) if whole.num_rows else pa.array([], kind)
    return shard(column("doc_id", pa.int64()), column("text", pa.string()))


class Plan(NamedTuple):
    """A block of items: the terms asked for, how often by each item (terms x items), weights, and the corpus' numbers."""

    terms: list[str]
    asked: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_words: int

    def part(self, tf: np.ndarray, length: np.ndarray, weight: int) -> np.ndarray:
        m = 100 - 25 + 25 * length * self.n_docs // self.n_words
        return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Results:
    """The best documents of each item, in heaps keyed by score, then doc_id."""

    def __init__(self, items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score below this is of no use

    def offer(self, doc_id: int | None, scores: np.ndarray) -> None:
        key = (doc_id is not None, -doc_id if doc_id is not None else 0)
        for item in np.flatnonzero(scores >= self.least).tolist():
            heap, entry = self.heaps[item], (int(scores[item]), key)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]


def merge(plan: Plan, doc_ids: list, lengths: np.ndarray, lists: list[tuple[int, np.ndarray, np.ndarray]], results: Results) -> None:
    """Scores a shard's documents one after the other: the heap always holds each list's next document.

    `lists`: (term, documents, occurrences), documents ascending. A document's score for every item of the block is the sum
    of its terms' parts, each as often as the item repeats the term.
    """
    n = len(plan.terms)
    parts = {t: iter(plan.part(tf, lengths[docs], int(plan.weights[t])).tolist()) for t, docs, tf in lists}
    streams = [(docs * n + t).tolist() for t, docs, _ in lists]
    for doc, entries in groupby(heapq.merge(*streams), key=lambda e: e // n):
        terms = [e - doc * n for e in entries]
        results.offer(doc_ids[doc], np.array([next(parts[t]) for t in terms], np.int64) @ plan.asked[terms])


def item_blocks(items: DataFrame, limit: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Items in blocks of at most `limit` bytes of text, or one item: ids, and terms with repeats."""
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        more = len((row.text or "").encode())
        if texts and size + more > limit:
            yield ids, _terms(texts)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += more
    yield ids, _terms(texts)


def _terms(texts: list[str | None]) -> list[list[str]]:
    found = words(pa.array(texts, pa.string()), ALNUM)
    names = found.vocabulary.to_pylist()
    return [[names[j] for j in found.ids[a:b].tolist()] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]


def _document_counts(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each asked term is; only the terms and counts of the index are read."""
    wanted = index.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            place = np.asarray(pc.fill_null(pc.index_in(batch.column("terms").flatten(), value_set=wanted.value), -1), dtype=np.int64)
            np.add.at(total, place[place >= 0], np.asarray(batch.column("dfs").flatten())[place >= 0])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    rows = index.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {terms[r.term]: r.df for r in rows}


def _served(index: DataFrame, plan: Plan, first: int, top: int) -> DataFrame:
    """(item place, doc_id, score): each task's best of its shards."""
    shared = index.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        results, wanted = Results(plan.asked.shape[1], top), pa.array(plan.terms, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("doc_ids", "lengths", "terms", "starts", "postings")}
                slot = np.asarray(pc.fill_null(pc.index_in(row["terms"].values, value_set=wanted), -1), dtype=np.int64)
                starts, data = np.asarray(row["starts"].values), np.frombuffer(row["postings"].as_buffer(), np.uint8)
                lists = []
                for j in np.flatnonzero(slot >= 0).tolist():
                    pairs = unpacked(data[starts[j] : starts[j + 1]])
                    lists.append((int(slot[j]), np.cumsum(pairs[::2]), pairs[1::2]))
                merge(plan, row["doc_ids"].as_py(), np.asarray(row["lengths"].values), lists, results)
        found = [(first + item, -key[1] if key[0] else None, score) for item, heap in enumerate(results.heaps) for score, key in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["item", "doc_id", "score"])

    return index.select("doc_ids", "lengths", "terms", "starts", "postings").mapInArrow(run, "item long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, top: int = TOP, limit: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item, from all shards of the index.

    Items come in blocks (of 1 MB of text); each is broadcast and meets every shard. A term's documents and the
    corpus' numbers come from the index, so weights are those of all documents. Within a shard all lists of the block's
    terms are merged document by document through one heap; a task keeps a heap of `top` results an item over its shards, and
    the tasks' results are ranked by score, then doc_id (null last).

    Items without terms, or null, find nothing; a repeated item is answered each time; repeated documents are ranked each.
    """
    spark, out, names = index.sparkSession, [], []
    n_docs, n_words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    for ids, terms in item_blocks(items, limit):
        first = len(names)
        names += ids
        own = sorted({t for x in terms for t in x})
        if not own or not n_words:
            continue
        counts = _document_counts(index, own)
        own = [t for t in own if t in counts]
        number = {t: k for k, t in enumerate(own)}
        asked = np.zeros((len(own), len(ids)), np.int64)
        for item, x in enumerate(terms):
            for t in x:
                if t in number:
                    asked[number[t], item] += 1
        if own:
            plan = Plan(own, asked, np.array([weight(n_docs, counts[t]) for t in own], np.int64), n_docs, n_words)
            out.append(_served(index, plan, first, top))
    found = out[0] if out else spark.createDataFrame([], "item long, doc_id long, score long")
    for more in out[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    known = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {dict(items.dtypes)['item_id']}")
    return ranked.join(known, "item").select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def _sql_terms(source: str, columns: str) -> str:
    return f"SELECT {columns}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM {source}"


ORACLE = f"""
WITH d AS ({_sql_terms("(SELECT row_number() OVER () AS k, * FROM documents)", "k, doc_id")}),
q AS (SELECT j, item_id, term, count(*) AS times FROM ({_sql_terms("(SELECT row_number() OVER () AS j, * FROM benchmark)", "j, item_id")}) GROUP BY ALL),
tfs AS (SELECT k, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
sizes AS (SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY k),
corpus AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, corpus GROUP BY term),
parts AS (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl))) AS part FROM tfs JOIN sizes USING (k) JOIN weights USING (term), corpus),
scores AS (SELECT j, item_id, k, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM q JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
WHERE rank <= {TOP}
"""
