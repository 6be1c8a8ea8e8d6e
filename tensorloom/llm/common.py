"""Helpers shared by the training-data operators: shared storage, Arrow text buffers, word hashes."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.sources.storage import checkpointed, shared_dir

#: The six ASCII white-space bytes that end a word, and the word pattern built on them.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that a task turns into numpy arrays at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

#: Rows of a range partition of a running sum, on average.
BUCKET_ROWS = 16384


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from (a null id is in no fold)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash52(text: Column) -> Column:
    """52 bits of md5 as a long: the same number in any engine that has md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def numbered(df: DataFrame) -> DataFrame:
    """`df` kept in the shared folder, each row with a number of its own (`rid`): equal rows can be told apart."""
    return checkpointed(df.withColumn("rid", F.monotonically_increasing_id()))


def running(df: DataFrame, rows: int, order: list[str], size: Column, *group: str, name: str = "before") -> DataFrame:
    """`df` (of about `rows` rows) with the sum of `size` over the rows before, in the order of `order` within `group`.

    `order` ends in what tells all rows of a group apart. Range partitions in the global order come first, of about
    BUCKET_ROWS rows, or more if that were more partitions than the session shuffles into; sums run within each of them, and
    over one row for each partition and group. So a group of any size is spread over many tasks, and so are rows that only
    the last column of the order tells apart. The groups must not be null.
    """
    spark = df.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BUCKET_ROWS)))
    ranged = checkpointed(df.repartitionByRange(parts, *group, *order).withColumns({"_part": F.spark_partition_id(), "_size": size.cast("long")}))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("_part", *group).agg(F.sum("_size").alias("_sum")).select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return summed.join(firsts, ["_part", *group]).withColumn(name, F.col(name) + F.col("_first")).drop("_part", "_size", "_first")


def with_schema(df: DataFrame, **types: str) -> T.StructType:
    """The schema of `df` with further columns, for mapInArrow."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in types.items():
        out = out.add(name, kind)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more at the end). Nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
_SHORT = 48


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xD1B54A32D192ED03)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every white-space separated word, and each row's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    lengths = np.flatnonzero(solid & ~after) + 1 - starts
    short = np.minimum(lengths, _SHORT + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    at, size = starts[order], short[order].astype(np.int64)
    h = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(min(_SHORT, int(size[0]) if len(size) else 0)):
        m = int(np.searchsorted(-size, -k, side="left"))
        h[:m] = (h[:m] ^ data[at[:m] + k]) * np.uint64(0x100000001B3)
    h = mix(h)
    for i in np.flatnonzero(size > _SHORT):
        s = starts[order[i]]
        h[i] = xxhash.xxh3_64_intdigest(data[s : s + lengths[order[i]]].tobytes())
    out = np.empty_like(h)
    out[order] = h
    return out, np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, steps: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word groups at distances `steps` from each word, within a row, and the row of each."""
    reach = max(steps, default=0)
    n = len(words) - reach
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    h = words[:n] + np.uint64(salt)
    for s in steps:
        h = mix(h) + words[s : s + n]
    inside = row[:n] == row[reach:]
    return mix(h[inside]), row[:n][inside]
