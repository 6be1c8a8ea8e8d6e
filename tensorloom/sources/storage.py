"""Where intermediate results live: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_tensorloom_dir", None)
    if not base and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = sc._tensorloom_dir = tempfile.mkdtemp(prefix="tensorloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed and kept there: a lost executor loses nothing, and a loop's plan stays short."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table of files there, which stay: Spark then knows its true size.

    A checkpoint keeps the estimate of its plan, in which the sizes of joined tables are multiplied. In a loop whose iterates
    are joined with each other that number's digits multiply with every round, and the driver is busy with nothing else.
    """
    path = f"{shared_dir(df.sparkSession)}/iterate-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
