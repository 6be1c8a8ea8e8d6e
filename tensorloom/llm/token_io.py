"""Token ids in binary files: documents in id order, frames compressed by a Re-Pair grammar, decoded at random."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import scratch, slices
from tensorloom.llm.tokens import default_path, piece_tokenizer

#: Ids of a frame (the unit that has a grammar of its own), on average; a document is never split over frames.
FRAME_IDS = 1 << 19
#: Bytes of text in a shard file, on average: at most, and at least where the session has tasks for more shards than that makes.
SHARD_BYTES = 256 << 20
LEAST_BYTES = 4 << 20
#: How often a pair must be replaced to pay for its rule: that has two symbols and a length of 8 bytes, four symbols in all.
MIN_COUNT = 5
_BIN_BITS = 18

FRAME_SCHEMA = (
    "shard int, frame int, first_id long, last_id long, shard_ids long, ids_before long, doc_ids binary, doc_nulls binary, doc_lengths binary, doc_symbols binary, symbols binary, rules binary, rule_lengths binary"
)


def _replaced(seq: np.ndarray, last: np.ndarray, near: np.ndarray, level: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, places, pair of each place, places left over): what a round replaces, of the neighbours that start at `near`.

    The pairs that occur `level` times or more compete for the places where they overlap: the more frequent one has it
    (ties: the smaller pair), and of a run of one symbol every other place is taken. A pair left with fewer than
    `min_count` places waits for a later round.
    """
    key = seq[near].astype(np.int64) << 32 | seq[near + 1]
    pairs, times = np.unique(key, return_counts=True)
    pairs, times = pairs[times >= level], times[times >= level]
    if not len(pairs):
        return pairs, near[:0], near[:0], near[:0]
    pair = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    hit = pairs[pair] == key
    at, pair = near[hit], pair[hit]
    rank = np.empty(len(pairs), np.int64)
    rank[np.lexsort((-pairs, times))] = np.arange(len(pairs))
    mine = rank[pair]
    joined = np.diff(at) == 1
    same = joined & (np.diff(pair) == 0)
    start = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(at)), 0))
    take = (np.arange(len(at)) - start) % 2 == 0
    take[1:] &= ~joined | same | (mine[1:] > mine[:-1])
    take[:-1] &= ~joined | same | (mine[:-1] > mine[1:])
    pays = np.bincount(pair[take], minlength=len(pairs)) >= min_count
    take &= pays[pair]
    return pairs[pays], at[take], (np.cumsum(pays) - 1)[pair[take]], at[~take]


def repair(ids: np.ndarray, ends: np.ndarray, first_rule: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one frame: (symbols, symbol ends of the documents, rules as an n x 2 array).

    The most frequent pairs become rules first: a round takes those within half of the largest count (see `_replaced`),
    the next one starts from what is left. It ends when no pair could be replaced `min_count` times. Pairs reach over no
    document's end.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    symbol, level, near = first_rule, len(seq), None
    while len(seq) > 1:
        if near is None:
            bins = (seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - _BIN_BITS)
            count = np.bincount(bins, minlength=1 << _BIN_BITS)  # a bin's count bounds its pairs' counts
            level = max(min_count, min(level, int(count.max())) // 2)
            near = np.flatnonzero((count >= level)[bins])
            near = near[~last[near]]
        new, at, rule, left = _replaced(seq, last, near, level, min_count)
        near = None
        if not len(new):
            if level == min_count:
                break
            continue
        rules.append(np.column_stack((new >> 32, new & 0xFFFFFFFF)))
        seq[at] = rule + symbol
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        if level == min_count:  # only pairs with a new symbol, and those that lost places, can have become rules
            moved = at - np.arange(len(at))
            left = left[keep[left]]
            near = np.unique(np.concatenate((moved[moved > 0] - 1, moved, left - np.searchsorted(at, left))))
        seq, last = seq[keep], last[keep]
        if near is not None:
            near = near[~last[near]]
        symbol += len(new)
    rows = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    stops = np.flatnonzero(last) + 1
    out = np.zeros(len(ends), np.int64)
    filled = np.diff(ends, prepend=0) > 0
    out[filled] = stops
    return seq, np.maximum.accumulate(out) if len(out) else out, rows


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for. Rules refer to earlier ones only."""
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append((lengths[a - first_rule] if a >= first_rule else 1) + (lengths[b - first_rule] if b >= first_rule else 1))
    return np.asarray(lengths, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids behind a run of symbols: each rule is spelled out once, then all symbols are gathered from there."""
    symbols = symbols.astype(np.int64)
    if not len(rules) or not (symbols >= first_rule).any():
        return symbols.astype("<u4")
    lengths = rule_lengths(rules, first_rule) if lengths is None else lengths
    spelled: list[list[int]] = []
    for a, b in rules.tolist():
        spelled.append((spelled[a - first_rule] if a >= first_rule else [a]) + (spelled[b - first_rule] if b >= first_rule else [b]))
    known = int(lengths.sum())
    source = np.concatenate((np.fromiter(chain.from_iterable(spelled), np.uint32, known), symbols.astype(np.uint32)))
    firsts = np.cumsum(lengths) - lengths
    rule = np.maximum(symbols - first_rule, 0)
    is_rule = symbols >= first_rule
    size = np.where(is_rule, lengths[rule], 1)
    start = np.where(is_rule, firsts[rule], known + np.arange(len(symbols)))
    shift = (start - (np.cumsum(size) - size)).astype(np.int32)
    return source[np.arange(int(size.sum()), dtype=np.int32) + np.repeat(shift, size)].astype("<u4", copy=False)


def expand_part(symbols: np.ndarray, rules: np.ndarray, first_rule: int, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The ids from `start` to `stop` behind a run of symbols: the rules' lengths tell what to pass over, unspelled."""
    size = np.where(symbols >= first_rule, lengths[np.maximum(symbols.astype(np.int64) - first_rule, 0)], 1) if len(rules) else np.ones(len(symbols), np.int64)
    ends = np.cumsum(size)
    lo, hi = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    todo, out = symbols[lo:hi][::-1].tolist(), []
    at = int(ends[lo - 1]) if lo else 0
    while todo and at < stop:
        s = todo.pop()
        n = int(lengths[s - first_rule]) if s >= first_rule else 1
        if at + n <= start:
            at += n
        elif s < first_rule:
            out.append(s)
            at += 1
        else:
            todo += (int(rules[s - first_rule, 1]), int(rules[s - first_rule, 0]))
    return np.asarray(out, "<u4")


def _frame(shard: int, number: int, before: int, doc_ids: list, lengths: list[int], parts: list[np.ndarray], first_rule: int) -> dict:
    ids = np.concatenate(parts)
    ends = np.cumsum(np.asarray(lengths, np.int64))
    symbols, symbol_ends, rules = repair(ids, ends, first_rule)
    return {
        "shard": shard,
        "frame": number,
        "first_id": min((x for x in doc_ids if x is not None), default=None),
        "last_id": max((x for x in doc_ids if x is not None), default=None),
        "shard_ids": before + len(ids),
        "ids_before": before,
        "doc_ids": np.asarray([x or 0 for x in doc_ids], "<i8").tobytes(),
        "doc_nulls": np.asarray([x is None for x in doc_ids], bool).tobytes(),
        "doc_lengths": np.asarray(lengths, "<i8").tobytes(),
        "doc_symbols": symbol_ends.astype("<i8").tobytes(),
        "symbols": symbols.astype("<u4").tobytes(),
        "rules": rules.astype("<u4").tobytes(),
        "rule_lengths": rule_lengths(rules, first_rule).astype("<i8").tobytes(),
    }


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, first_rule: int = 1 << 20, shard_bytes: int = SHARD_BYTES, least_bytes: int = LEAST_BYTES) -> None:
    """Writes the ids of all texts, documents in ascending doc_id order, as frames of compressed ids.

    Range partitions by doc_id (ties: by a hash of the text) become shards, in order. Each partition is sorted and read
    as a stream; a frame holds about FRAME_IDS ids, or one document, so that frames, not shards, bound a task's memory. The
    number of shards grows with the bytes of text (`shard_bytes` each); a table that makes fewer than the session shuffles
    into is cut into as many as those, of at least `least_bytes`. Null texts are empty (the end id alone), a null
    doc_id comes first, repeated rows are each kept; an empty table makes no frame. Further columns are left out.
    The files are Parquet with binary columns, so that any store that Spark writes to will do.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // least_bytes)))
    schema = docs.sparkSession.createDataFrame([], FRAME_SCHEMA).schema
    names = schema.names

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard = piece_tokenizer(tokenizer), TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4")
        number = before = held = 0
        doc_ids, lengths, parts = [], [], []

        def flush():
            nonlocal number, before, held, doc_ids, lengths, parts
            row = _frame(shard, number, before, doc_ids, lengths, parts, first_rule)
            number, before, held, doc_ids, lengths, parts = number + 1, before + held, 0, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tok.encode_all(batch.column("text").to_pylist()), strict=True):
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                parts += (ids, end)
                held += len(ids) + 1
                if held >= FRAME_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[t.dataType.simpleString()]) for n, t in zip(names, schema.fields, strict=True)])
    (
        rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text")
        .mapInArrow(encode, schema)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first_rule: int = 1 << 20, ids: bool = True) -> DataFrame:
    """Each document read back: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids.

    A document's start is its place in its shard plus the ids of the shards before; the latter come from one row a shard.
    """
    rows = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                lengths = np.frombuffer(row["doc_lengths"], "<i8")
                whole = expand(np.frombuffer(row["symbols"], "<u4"), rules, first_rule, np.frombuffer(row["rule_lengths"], "<i8"))
                ends = np.cumsum(lengths)
                raw = memoryview(whole.tobytes())
                out = {
                    "shard": pa.array([row["shard"]] * len(lengths), pa.int32()),
                    "doc_id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_nulls"], bool)),
                    "place": pa.array(row["ids_before"] + ends - lengths),
                    "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64()),
                }
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(whole.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    kinds = "shard int, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    read = rows.select("shard", "ids_before", "rules", "rule_lengths", "symbols", "doc_lengths", "doc_ids", "doc_nulls").mapInArrow(decode, kinds)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard").agg(F.max("shard_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return read.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def read_document(spark: SparkSession, path: str, doc_id: int, start: int = 0, stop: int | None = None, first_rule: int = 1 << 20) -> list[np.ndarray]:
    """Random access: the ids from `start` to `stop` (the end) of one document (each, if the id comes again).

    Only frames whose first and last ids enclose `doc_id` are read (the store's statistics skip the others), and only
    what lies between the two places is spelled out.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero((np.frombuffer(row["doc_ids"], "<i8") == doc_id) & ~np.frombuffer(row["doc_nulls"], bool))
                ends, size = np.concatenate(([0], np.frombuffer(row["doc_symbols"], "<i8"))), np.frombuffer(row["doc_lengths"], "<i8")
                rules, lengths = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<i8")
                symbols = np.frombuffer(row["symbols"], "<u4")
                found = [expand_part(symbols[ends[i] : ends[i + 1]], rules, first_rule, lengths, start, size[i] if stop is None else min(stop, size[i])).tobytes() for i in at]
                yield pa.RecordBatch.from_pydict({"ids": pa.array(found, pa.binary())})

    frames = spark.read.parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    rows = frames.select("rules", "rule_lengths", "symbols", "doc_symbols", "doc_lengths", "doc_ids", "doc_nulls").mapInArrow(pick, "ids binary").collect()
    return [np.frombuffer(r["ids"], "<u4") for r in rows]


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "op4")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_path("byte_bpe_50k.json"))
    return read_tokens(spark, path, ids=False)


ORACLE = None
