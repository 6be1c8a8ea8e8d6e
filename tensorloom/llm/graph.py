"""Connected components of links between documents, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed

#: Links that one task of a round handles, on average.
TASK_LINKS = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (columns a, b); a component is named by its smallest node.

    Alternating large-star and small-star steps until the edges are stars around their smallest nodes; about log of the
    longest path many rounds, each kept in the shared folder. Nodes with many links are pre-aggregated by min() and
    their joins left to adaptive skew splitting. A round has a few exchanges of links only, so its stages get as many
    tasks as the links fill (up to the session's shuffle partitions): few links make few files. Null ends and loops are
    no links.
    """
    spark = links.sparkSession
    edges = checkpointed(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while True:
        tasks = max(spark.sparkContext.defaultParallelism, -(-state[0] // TASK_LINKS))
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
