"""A corpus pipeline of the training-data operators: from raw documents to packed token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import mixing, neardup, packing, secret_scan, toxicity
from tensorloom.llm.common import checkpointed, scratch, table
from tensorloom.llm.tokens import default_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model, learned from the table `labels`, gives a score of 0.3 or more."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked at a similarity of 0.8 or more.

    Of rows that repeat an id, the smallest stays. Rows without an id stay all.
    """
    marks = checkpointed(neardup.near_duplicates(docs, neardup.Scheme(percent=80, chunks=14, width=4)))
    gone = marks.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    again = marks.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    once = kept.join(again, "doc_id", "left_anti")
    first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return once.unionByName(first)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each secret in its place; n_chars follows."""
    found = secret_scan.scan(docs.select(*COLUMNS), redacted=True)
    changed = F.col("spans") != ""
    return found.select(
        "doc_id",
        F.when(changed, F.col("redacted")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts the sources to their targets: a document comes as often as the mix takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into token windows, one row a piece."""
    return packing.pack(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can express neither the model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
