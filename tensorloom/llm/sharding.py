"""Sharding by rendezvous hashing over weighted shards (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import hash52, numbered, running


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose exponential clock, run by a hash of key and shard at the shard's weight, rings first.

    A shard that is added can only ring before the others, so rows move into it alone; the share of a shard follows its
    weight. A null key is one key.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    ring = [F.struct((-F.ln((hash52(F.concat(F.lit(f"{i}:"), key)) + 0.5) / float(1 << 52)) / float(w)).alias("t"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*ring))["i"]


def shard(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, the slot within the shard and the shard if there were one more.

    Slots number a shard's rows from 0 without gaps in the order of a hash of the key (ties: the key, the text's checksum, the
    size, the row's own number). They are a running count over range partitions, so that no task sees a whole shard, nor
    all rows of a key that is null or comes again. Null texts have no bytes: size 1, checksum 0. Rows with equal keys share a shard; repeated rows
    each have a slot. Further columns are left out.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = numbered(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            rendezvous(F.col(key), weights).alias("shard"),
            rendezvous(F.col(key), [*weights, 1.0]).alias("grown_shard"),
            hash52(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("h"),
        )
    )
    slots = running(rows, rows.count(), ["h", "doc_id", "text_crc32", "size", "rid"], F.lit(1), "shard", name="slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, 16).withColumn("law", F.lit("key"))


#: text_crc32 is left to a test: DuckDB has no crc32.
ORACLE = None
