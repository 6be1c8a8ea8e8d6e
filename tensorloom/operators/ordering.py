"""Sorting as data: positions, permutations, subsets and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.operators.selection import hash01
from tensorloom.sources.storage import checkpointed


def argsort(df: DataFrame, *by: str, name: str = "position") -> DataFrame:
    """`df` with each row's place (from 0) in the global order of `by`, which should end in a unique column.

    Range partitions are sorted side by side; a row's place is its place in the partition plus the rows of the
    partitions before, of which one count each is summed.
    """
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = checkpointed(rows)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def positions(df: DataFrame, within: tuple[str, ...], *by: str, name: str = "position") -> DataFrame:
    """`df` with each row's place (from 0) in the order of `by`, which should end in a unique column, in its group `within`.

    As `argsort`: places within range partitions, and before each the rows of its group in earlier partitions, of which
    one count a partition and group is summed. So a group of any size is spread over many tasks. Null is a group.
    """
    group = F.struct(*within) if within else F.lit(0)
    rows = checkpointed(df.repartitionByRange(*within, *by).withColumns({"_part": F.spark_partition_id(), "_group": group}))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part", "_group").count().select("_part", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part", "_group").orderBy(*by)
    placed = rows.withColumn("_place", F.row_number().over(inside) - 1).join(starts, ["_part", "_group"])
    return placed.withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_part", "_group", "_start", "_place")


def apply_permutation(values: DataFrame, permutation: DataFrame) -> DataFrame:
    """Gather: values (position, v...) at permutation (position, source)."""
    return permutation.join(values.withColumnRenamed("position", "source"), "source")


def inverse_permutation(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("source").alias("position"), F.col("position").alias("source"))


def random_subset(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by hash order: the same ones in every run."""
    return df.orderBy(hash01(F.col(key), seed), key).limit(n)


def best_of(df: DataFrame, group: str, objective: str, *params: str) -> DataFrame:
    """Per group the parameters at the smallest objective (ties: the smallest parameters)."""
    return df.groupBy(group).agg(F.min(F.struct(objective, *params)).alias("_b")).select(group, f"_b.{objective}", *[f"_b.{p}" for p in params])


def pivot_argmax(df: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """Per group the index of the largest absolute value (ties: the smallest index)."""
    return df.groupBy(group).agg(F.max(F.struct(F.abs(value).alias("top"), (-F.col(index)).alias("at"))).alias("_b")).select(group, (-F.col("_b.at")).alias("pivot"), "_b.top")
