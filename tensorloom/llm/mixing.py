"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import WORD, checkpointed, hash52, numbered, running, word_count

#: A document is used at most so often.
MAX_EPOCHS = 3


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3 and again, by the source's place in code point order."""
    return ((rank - 1) % 3 + 1).cast("double")


def source_targets(sized: DataFrame, weight=cyclic_weight, share: float = 1.0, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source its rank, size, weight, target, and `budget`, the words of the whole mix.

    The virtual time at which the queues have served `share` of all words is the largest of the levels
    (budget - what the sources before have at most) / weight of the rest, sources taken in the order in which they
    run dry; a source's target is its weight times that time, and `epochs` times its size at most. One row a source.
    """
    every = Window.partitionBy()
    dry = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(dry.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(dry.rowsBetween(0, Window.unboundedFollowing))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight(F.col("rank")))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - before) / left)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(every)))
        .select("source", "rank", "source_size", "weight", "target", F.floor("budget").alias("budget"))
    )


def shuffled(seed: str) -> Column:
    """A row's place in its source's queue: a hash of its id, source and text, so that only equal rows tie."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "source", "text")]
    return hash52(F.concat_ws(":", F.lit(seed), *parts))


def packets(placed: DataFrame, epochs: int) -> DataFrame:
    """(rid, run, rank, words, virtual_finish) of what the queues have begun to serve when the budget is spent.

    Each run of a source's queue serves its documents again. A packet is a document, finished at (words of the source up
    to its end, all runs) / weight. The one document in service at a source's target is two packets: the words finished by
    then, and the word in hand; packets not begun by then come after the whole budget.
    """
    done = F.floor("target")
    before = lambda run: F.col("start") + F.col("source_size") * run
    head = lambda run: F.greatest(F.lit(0), F.least(F.col("size"), done - before(run)))
    in_hand = lambda run: ((before(run) <= done) & (done < before(run) + F.col("size")) & (F.col("target") > done)).cast("long")
    parts = [F.struct(F.lit(run).alias("run"), w.alias("words"), ((before(run) + end) / F.col("weight")).alias("virtual_finish")) for run in range(epochs) for w, end in ((head(run), head(run)), (in_hand(run), head(run) + 1))]
    return placed.select("rid", "rank", F.explode(F.filter(F.array(*parts), lambda p: p["words"] > 0)).alias("_p")).select("rid", "rank", "_p.*")


def queue(docs: DataFrame, weight=cyclic_weight, share: float = 1.0, seed: str = "mix", epochs: int = MAX_EPOCHS, carry: tuple[Column, ...] = ()) -> DataFrame:
    """Each document's place in its source's shuffled queue, and what the mix takes of it.

    Gives rid, doc_id, source, size, source_size, weight, target, h, `start` (words of the source before it),
    `virtual_finish` (words of the source up to its end, divided by the weight, in the first run), `runs` (the words taken
    in each of `epochs` runs of the queue) and `taken`, their sum, beside the columns of `docs` in `carry`.

    The packets of all queues are sorted by virtual finish time over range partitions (ties: by the source's rank); the
    words before each come from a running sum in two steps, and the mix ends where they reach the budget: `share` of all
    words. Each source's words are within one of its target. The order within a source is a hash of the row, and equal rows
    are told apart by a number, so that a source, an id or a row that holds most of the table is spread over many tasks.
    Null texts have size 0 and take nothing; a null source is a source of its own, last in order; repeated rows each
    count; an empty table gives no rows. Further columns of `docs` are left out, so that no name can clash.
    """
    slim = numbered(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffled(seed).alias("h"), *carry))
    targets = source_targets(slim, weight, share, epochs).withColumnRenamed("source", "_source")
    known = slim.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    n = slim.count()
    placed = checkpointed(running(known, n, ["h", "rid"], F.col("size"), "rank", name="start"))
    budget = placed.agg(F.max("budget").alias("budget"))
    served = running(packets(placed, epochs), n, ["virtual_finish", "rank"], F.col("words"))
    words = F.least(F.col("words"), F.greatest(F.lit(0).cast("long"), budget.scalar() - F.col("before")))
    taken = served.withColumn("_w", words).where("_w > 0").groupBy("rid").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("run") == e, F.col("_w"))), F.lit(0)) for e in range(epochs)]).alias("_runs"))
    runs = F.coalesce("_runs", F.array_repeat(F.lit(0).cast("long"), epochs))
    return (
        placed.join(taken, "rid", "left")
        .withColumn("runs", runs)
        .withColumns({"virtual_finish": (F.col("start") + F.col("size")) / F.col("weight"), "taken": sum((F.col("runs")[e] for e in range(epochs)), F.lit(0).cast("long"))})
        .drop("_runs", "rank", "budget")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """`queue()` in the mix's order: sorted by virtual finish time over range partitions."""
    return queue(docs, **options).repartitionByRange("virtual_finish", "h").sortWithinPartitions("virtual_finish", "h").drop("h", "rid", "runs")


def mixed_documents(docs: DataFrame, epochs: int = MAX_EPOCHS, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; the last one of a source is cut after its last word taken.

    Keeps the columns of `docs` (n_chars, where present, follows a cut). Each of several equal rows is taken for itself:
    their takes are counted, and one of them is repeated so often. Texts without words are in no mix and go.
    """
    plain = [F.col(c) for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    keys = [F.xxhash64(F.lit(k), *plain).alias(f"_k{k}") for k in (0, 1)]
    names = ["_k0", "_k1"]
    queued = checkpointed(queue(docs, epochs=epochs, carry=tuple(keys), **options).select(*names, "rid", F.col("size").alias("_size"), "runs"))
    again = checkpointed(queued.groupBy(*names).count().where("count > 1").select(*names))
    takes = queued.select(*names, "rid", "_size", F.explode("runs").alias("_words")).where("_words > 0")
    rows = docs.select(*keys, F.struct(*docs.columns).alias("_doc"))
    once = rows.join(again, names, "left_anti").join(takes.drop("rid"), names)
    one = rows.join(again, names, "left_semi").groupBy(*names).agg(F.first("_doc").alias("_doc"))
    dealt = takes.join(again, names, "left_semi").groupBy(*names, "_size", "_words", F.pmod("rid", F.lit(256)).alias("_deal")).agg(F.count("*").cast("int").alias("_n"))
    often = one.join(dealt, names).repartition("_k0", "_words", "_deal").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    every = once.select("_doc", "_size", "_words").unionByName(often.select("_doc", "_size", "_words"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("_doc.text"), F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    short = F.col("_words") < F.col("_size")
    new = {"text": F.when(short, cut).otherwise(F.col("_doc.text")), "n_chars": F.when(short, F.char_length(cut).cast("long")).otherwise(F.col("_doc.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return every.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "virtual_finish")


ORACLE = """
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(source, 'null') || ':' || coalesce(text, 'null')), 1, 13) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source COLLATE C ASC NULLS LAST) AS rank FROM sources),
weighed AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, rank, source_size, weight, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM levels),
placed AS MATERIALIZED (
  SELECT s.rid, s.doc_id, s.size, t.source_size, t.target, s.source, t.rank, t.weight, CAST(floor(t.target) AS BIGINT) AS done,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.h, s.rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
serving AS (
  SELECT *, start + run * source_size AS begins, greatest(0, least(size, done - (start + run * source_size))) AS head
  FROM placed, (SELECT unnest(range(3)) AS run)),
packets AS (
  SELECT rid, rank, head AS words, (begins + head) / weight AS finish FROM serving WHERE head > 0
  UNION ALL SELECT rid, rank, 1, (begins + head + 1) / weight FROM serving WHERE begins <= done AND done < begins + size AND target > done),
served AS (
  SELECT rid, words, coalesce(sum(words) OVER (ORDER BY finish, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM packets),
taken AS (
  SELECT rid, CAST(sum(least(words, greatest(0, (SELECT sum(size) FROM sized) - before))) AS BIGINT) AS taken FROM served GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, source, (start + size) / weight AS virtual_finish
FROM placed LEFT JOIN taken USING (rid)
"""
