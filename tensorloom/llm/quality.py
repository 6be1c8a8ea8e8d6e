"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import WORD

# Common short words of English, French, German and Spanish, by language.
STOP_WORDS = (
    "the be to of and that have with is was for on are as this it in at by from or an not but "
    "le la les des et est une un que qui dans pour pas sur avec au du de par plus "
    "der die das und ist von zu den mit sich ein eine nicht auf im dem es "
    "el los las y en del se por con una para como su al lo"
).split()

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\u000b\f\r"


@dataclass(frozen=True)
class Threshold:
    """A ratio and the range it must lie in; texts outside fail."""

    name: str
    top: str
    bottom: str
    least: float = float("-inf")
    most: float = float("inf")


#: Lengths, symbols, stop words and lines. The bounds are wide: they are meant for texts that are no prose in any language.
TABLE = (
    Threshold("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Threshold("symbol_ratio", "n_symbols", "n_words", most=0.3),
    Threshold("stop_word_ratio", "n_stop_words", "n_words", least=0.02),
    Threshold("dup_line_ratio", "n_dup_lines", "n_lines", most=0.5),
)


def measured(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the counts of each whole text.

    Repeated windows: the hashes of a text's windows of `width` words are sorted with their places, and those next to an
    equal hash are repeated; taken by place, each covers `width` words, less what the one before has covered. Each step
    stands in a projection of its own and is named twice or more in the next, so that Spark makes it once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        F.translate(text, _WHITE, "").alias("_solid"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda x: x != "").alias("_words"),
    )
    solid, words = F.col("_solid"), F.col("_words")
    last = F.size(words) - width
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    counted = split.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(solid).cast("long").alias("word_chars"),
        (F.char_length(solid) - F.char_length(F.translate(solid, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)).alias("_windows"),
    )
    windows = F.col("_windows")
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = counted.withColumn("_order", F.when(some, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    order = F.col("_order")
    same = lambda x, j: F.coalesce(x["h"] == F.get(order, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(order, j + 1)["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(order, same), lambda x: x["i"]))
    step = lambda acc, i: F.struct((i + width).alias("end"), (acc["n"] + i + width - F.greatest(i, acc["end"])).alias("n"))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_windows", "_order")


def verdict(table: tuple[Threshold, ...] = TABLE) -> Column:
    """All ratios of the table within their ranges, as one expression; a ratio over nothing passes."""
    out = F.lit(True)
    for t in table:
        ratio = F.col(t.top) / F.nullif(F.col(t.bottom), F.lit(0))
        if t.least != float("-inf"):
            out = out & F.coalesce(ratio >= t.least, F.lit(True))
        if t.most != float("inf"):
            out = out & F.coalesce(ratio <= t.most, F.lit(True))
    return out


def judge(docs: DataFrame, table: tuple[Threshold, ...] = TABLE) -> DataFrame:
    """One row a document: its counts, base_failed and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. Null and empty texts have no words and
    fail. Repeated rows are judged each; further columns are left out; an empty table gives no rows. No shuffle, no
    Python: one pass over the texts.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(table))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_verdict() -> str:
    parts = [f"coalesce({t.top} / nullif({t.bottom}, 0) >= {t.least}, true)" for t in TABLE if t.least != float("-inf")]
    return " AND ".join(parts + [f"coalesce({t.top} / nullif({t.bottom}, 0) <= {t.most}, true)" for t in TABLE if t.most != float("inf")])


ORACLE = f"""
WITH base AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '{WORD}') GROUP BY k),
words AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM base),
grams AS (SELECT k, i, [word, lead(word) OVER p, lead(word, 2) OVER p] AS g, lead(word, 2) OVER p IS NOT NULL AS whole
          FROM words WINDOW p AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i, whole AND count(*) OVER (PARTITION BY k, g) > 1 AS r FROM grams),
covered AS (SELECT k, count(*) FILTER (WHERE r OR r1 OR r2) AS n_repeat_words
            FROM (SELECT k, r, lag(r) OVER p AS r1, lag(r, 2) OVER p AS r2 FROM again WINDOW p AS (PARTITION BY k ORDER BY i)) GROUP BY k),
stops AS (SELECT k, count(*) AS n_stop_words FROM words WHERE lower(word) IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}) GROUP BY k),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines
  FROM base LEFT JOIN lines USING (k) LEFT JOIN covered USING (k) LEFT JOIN stops USING (k)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_sql_verdict()} AS kept, n_stop_words, n_lines
FROM judged
"""
