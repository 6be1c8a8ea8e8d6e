"""What the query modules share: tables in long form, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.tensor import Tensor, complex_entries, entries
from tensorloom.sources.readers import table

#: Fixed value: pi, spelled out so that both engines use the same number.
PI = "3.141592653589793"

#: The vectors in long form: (vec_id, label, i, re).
ENT = "ent AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS re FROM embeddings)"
#: The vectors as complex numbers: (vec_id, label, i, re, im).
CENT = """cent AS (SELECT vec_id, label, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im
  FROM (SELECT *, unnest(range(len(embedding) // 2)) AS i FROM embeddings))"""
#: The samples that line items stand for: coordinates in radians and a complex value.
SAMPLES = f"""samples AS (SELECT l_orderkey * 8 + l_linenumber AS s, l_returnflag AS batch,
  (l_quantity - 25) / 25 * {PI} AS kx, (l_discount * 10 - 0.5) * {PI} AS ky, (l_tax * 12 - 0.5) * {PI} AS kz,
  l_extendedprice / 10000 AS re, l_tax * 10 AS im FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> Tensor:
    return entries(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label")


def complex_vectors(spark: SparkSession, sf_dir: str) -> Tensor:
    return complex_entries(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pi = float(PI)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("s"),
        F.col("l_returnflag").alias("batch"),
        ((F.col("l_quantity") - 25) / 25 * pi).alias("kx"),
        ((F.col("l_discount") * 10 - 0.5) * pi).alias("ky"),
        ((F.col("l_tax") * 12 - 0.5) * pi).alias("kz"),
        (F.col("l_extendedprice") / 10000).alias("re"),
        (F.col("l_tax") * 10).alias("im"),
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")


def rounded(df: DataFrame, *keys: str, digits: int = 4, **values: Column) -> DataFrame:
    """Keys and values rounded for comparison; the zero's sign goes."""
    return df.select(*keys, *[(F.round(F.lit(v), digits) + 0.0).alias(n) for n, v in values.items()])


def rnd(expr: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0"


class Catalogue:
    """Queries with their SQL, by name."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.oracles[name] = sql

    def query(self, sql: str | None = None):
        """Registers a function under its own name."""

        def put(f):
            self.add(f.__name__, f, sql)
            return f

        return put
