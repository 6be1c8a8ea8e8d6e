"""Benchmark decontamination by winnowing: rare fingerprints of every window, joined, and hits extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.llm.common import checkpointed, mix, slices, table, with_schema
from tensorloom.llm.terms import ALNUM, SLICE_BYTES, words

#: Words of a window: every shared span of so many words is found.
WINDOW = 10

#: Words of a fingerprinted k-gram: each window has WINDOW - GRAM + 1 of them and keeps the smallest hash.
GRAM = 5

#: Bytes of item texts in a block: what is broadcast at once is at most some thirty times this, or one item's share.
BLOCK_BYTES = 8 << 20


class Level(NamedTuple):
    """All windows of one width: distinct, by a hash that tells them apart, with the items that hold each."""

    width: int
    salt: int
    prints: np.ndarray  # sorted fingerprints
    keys: np.ndarray  # sorted hashes of whole windows
    grams: np.ndarray  # the words of each
    first: np.ndarray  # where each window's items start
    items: np.ndarray


class Block(NamedTuple):
    """Some items: their vocabulary, a random value for each word, the levels, the item ids."""

    vocabulary: pa.Array
    values: np.ndarray
    levels: list[Level]
    names: list[str]


def _combined(values: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of the n values from each place on (as many as have n)."""
    m = max(len(values) - n + 1, 0)
    h = np.full(m, salt + n, np.uint64)
    for k in range(n):
        h = mix(h + values[k : k + m])
    return h


def winnowed(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` words, the smallest hash of its k-grams: equal windows have equal fingerprints."""
    k = min(GRAM, width)
    h = _combined(values, k)
    m = max(len(values) - width + 1, 0)
    low = h[:m]
    for j in range(1, width - k + 1):
        low = np.minimum(low, h[j : j + m])
    return low


def build(names: list[str], texts: list[str | None]) -> Block:
    """The fingerprints and windows of a block of items. An item without words has no window."""
    found = words(pa.array(texts, pa.string()), ALNUM)
    values = mix(np.arange(1, len(found.vocabulary) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    size = np.diff(found.bounds)
    levels = []
    for width in sorted({min(WINDOW, int(n)) for n in size if n}):
        own = np.flatnonzero(size >= WINDOW) if width == WINDOW else np.flatnonzero(size == width)
        places = np.concatenate([np.arange(found.bounds[i], found.bounds[i + 1] - width + 1) for i in own])
        items = np.repeat(own, size[own] - width + 1)
        grams, which = np.unique(found.ids[places[:, None] + np.arange(width)], axis=0, return_inverse=True)
        salt, keys = 1, _keys(values[grams], 1)
        while len(np.unique(keys)) < len(grams):  # until no two windows share a hash
            salt += 1
            keys = _keys(values[grams], salt)
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[which.ravel()], items], 1), axis=0)
        prints = np.unique(np.concatenate([winnowed(values[g], width) for g in grams]))
        levels.append(Level(width, salt, prints, keys[order], grams[order], np.searchsorted(pairs[:, 0], np.arange(len(grams) + 1)), pairs[:, 1]))
    return Block(found.vocabulary, values, levels, names)


def _keys(grams: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(grams), salt, np.uint64)
    for k in range(grams.shape[1]):
        h = mix(h + grams[:, k])
    return h


def _within(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of `wanted` are among the sorted values."""
    place = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[place] == wanted


def hits(block: Block, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, Level, np.ndarray]]:
    """Per level the places where a window of the block's items occurs, and which. `ids`: words of the block, or -1.

    A window's fingerprint is looked up among those of the items; what has one is extended to the whole window, which is
    looked up by its hash and compared word by word.
    """
    if not block.levels:
        return
    known = np.concatenate(([0], np.cumsum(ids >= 0)))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    values = block.values[np.maximum(ids, 0)]
    for level in block.levels:
        w = level.width
        if len(ids) < w:
            continue
        full = np.flatnonzero((known[w:] - known[:-w] == w) & (row[w - 1 :] == row[: len(row) - w + 1]))
        low = winnowed(values, w)[full]
        at = full[_within(level.prints, low)]
        grams = ids[at[:, None] + np.arange(w)]
        keys = _keys(block.values[grams], level.salt)
        place = np.minimum(np.searchsorted(level.keys, keys), len(level.keys) - 1)
        same = (level.keys[place] == keys) & (level.grams[place] == grams).all(axis=1)
        yield w, at[same], level, place[same]


def _marked(batch: pa.RecordBatch, block: Block) -> list[pa.Array]:
    """n_words, hit_starts, hit_ends and items of each row, with what earlier blocks have found."""
    found = words(batch.column("text"), ALNUM)
    n, rows = len(found.ids), batch.num_rows
    place = pc.index_in(found.vocabulary, value_set=block.vocabulary)
    ids = np.asarray(pc.fill_null(place, -1), dtype=np.int64)[found.ids] if n else np.zeros(0, np.int64)
    edge = np.zeros(n + 1, np.int64)
    names: list[set[str]] = [set(x or ()) for x in batch.column("items").to_pylist()]
    for i, (starts, ends) in enumerate(zip(batch.column("hit_starts").to_pylist(), batch.column("hit_ends").to_pylist(), strict=True)):
        for a, b in zip(starts or (), ends or (), strict=True):
            edge[found.bounds[i] + a] += 1
            edge[found.bounds[i] + b] -= 1
    for w, at, level, which in hits(block, ids, found.bounds):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + w, -1)
        row = np.searchsorted(found.bounds, at, side="right") - 1
        for i, k in np.unique(np.stack([row, which], 1), axis=0).tolist():
            names[i].update(block.names[j] for j in level.items[level.first[k] : level.first[k + 1]].tolist())
    hit = np.concatenate(([False], np.cumsum(edge[:n]) > 0, [False]))
    row_of = found.rows()
    first = np.concatenate((row_of[:1] != -2, row_of[1:] != row_of[:-1])) if n else np.zeros(0, bool)
    last = np.concatenate((first[1:], [True])) if n else first
    starts = np.flatnonzero(hit[1:-1] & (~hit[:-2] | first))
    ends = np.flatnonzero(hit[1:-1] & (~hit[2:] | last)) + 1
    lists = lambda x, shift: pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, found.bounds), pa.int32()), pa.array(x - found.bounds[:-1][row_of[starts]] + shift, pa.int32()))
    return [pa.array(np.diff(found.bounds), pa.int64()), lists(starts, 0), lists(ends, 0), pa.array([sorted(x) for x in names], pa.list_(pa.string()))] if rows else []


def item_blocks(items: DataFrame, limit: int) -> Iterator[Block]:
    """The items in blocks of at most `limit` bytes of text, or one item; one block at a time is on the driver."""
    names, texts, size = [], [], 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").toLocalIterator():
        more = len((row.text or "").encode())
        if texts and size + more > limit:
            yield build(names, texts)
            names, texts, size = [], [], 0
        names.append(row.name)
        texts.append(row.text)
        size += more
    yield build(names, texts)


def decontaminate(docs: DataFrame, items: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, hit_starts and hit_ends (runs of hit words, by number, end exclusive) and items (ids, ascending).

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A window is ten consecutive words of
    an item, or the whole of an item of fewer. Winnowing keeps the smallest 5-gram hash of each window, so that two texts
    that share ten words share a fingerprint; shorter items have windows, and fingerprints, of their own width. Documents
    are read once a block of items; a task holds a slice of texts and one block, and no document is shuffled. With one block
    (up to 8 MB of items) all is one pass; else each pass is kept in the shared folder before the next.

    Null and empty texts have no words and no hits. Repeated documents are each marked, repeated items and items without an id
    ("" in its place) count by their id. No items: no hits. Columns of `docs` of the same names are replaced. A single text
    takes about a hundred bytes a word while it is searched.
    """
    docs = docs.drop("n_words", "hit_starts", "hit_ends", "items")
    kept = docs.columns
    empty = {"n_words": F.lit(0).cast("long"), "hit_starts": F.array().cast("array<int>"), "hit_ends": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    ints, strings = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
    out = with_schema(docs, n_words=T.LongType(), hit_starts=ints, hit_ends=ints, items=strings)
    sc, marked, later = docs.sparkSession.sparkContext, docs.withColumns(empty), False
    for block in item_blocks(items, limit):
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, limit=SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *_marked(batch, shared.value)], names=out.names)

        marked = (checkpointed(marked) if later else marked).mapInArrow(run, out)
        later = True
    return marked


def digest(marked: DataFrame) -> DataFrame:
    """The contract's columns from what was marked."""
    n_hit = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def _sql_words(name: str, key: str, extra: str) -> str:
    return f"""{name} AS (
  SELECT {extra}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM {key})"""


ORACLE = f"""
WITH {_sql_words("d", "documents", "row_number() OVER () AS k, doc_id")},
{_sql_words("b", "benchmark", "row_number() OVER () AS k, coalesce(CAST(item_id AS VARCHAR), '') AS item")},
windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS width, w[i : i + least(len(w), {WINDOW}) - 1] AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
spans AS (
  SELECT k, i, width, w[i : i + width - 1] AS g
  FROM (SELECT k, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)),
found AS (SELECT k, i, s.width, item FROM spans s JOIN windows USING (g)),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + width)) AS p FROM found) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN named USING (k)
"""
