"""Phrase collocations: text fragments are routed to their rarest word, phrases are mined there, and scored by their best cut."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, mix, slices, table, utf8
from tensorloom.llm.terms import byte_set, words

#: Words of the longest phrase, and occurrences of the rarest one.
LONGEST, SUPPORT = 5, 100

#: Phrases returned for each language.
TOP = 2000

#: Words whose frequency is broadcast, the most frequent ones; all others count as rarer than these.
DICTIONARY = 1 << 17

#: Fragments of a pivot that are mined together; a more frequent pivot is split.
PIVOT_ROWS = 1 << 18

#: Languages whose word counts are broadcast.
LANGUAGES = 1 << 16

#: Parts in which a language's phrases are ranked before the best of each part meet.
PARTS = 64

#: Fragments that a task mines at a time, if no route has more.
CHUNK_ROWS = 1 << 17

#: The digits of a rank's code: no blanks, and no capital letters.
_DIGITS = np.array([*range(33, 65), *range(91, 127)], np.uint8)

#: Stands before a word that is spelled out, as it has no rank.
_SPELLED = 2

#: Bytes of text whose fragments are counted together before they are shuffled.
SLICE_BYTES = 2 << 20

_BREAKS = byte_set(b".,;:!?\n\x0b\x0c\r")
_SOLID = byte_set(b" \t.,;:!?\n\x0b\x0c\r", invert=True)


class Frequencies(NamedTuple):
    """rank: per language a word's place in the order of falling frequency, and in how many parts its fragments are mined.

    names: the word of each rank. whole: no word outside is frequent, so that any other ends a fragment.
    """

    rank: dict[str, dict[str, tuple[int, int]]]
    names: list[str]
    whole: bool
    rest: int  # parts of a word outside


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n); the row with a null word has all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE_BYTES):
            found = words(batch.column("text"), _SOLID)
            lang = batch.column("lang").dictionary_encode()
            of_word = np.asarray(lang.indices, dtype=np.int64)[found.rows()]
            size = max(len(found.vocabulary), 1)
            pair, n = np.unique(of_word * size + found.ids, return_counts=True)
            which, total = np.unique(of_word, return_counts=True)
            langs = lang.dictionary.take(pa.array(np.concatenate((pair // size, which))))
            names = pa.concat_arrays([found.vocabulary.take(pa.array(pair % size)).cast(pa.string()), pa.nulls(len(which), pa.string())])
            yield pa.RecordBatch.from_arrays([langs, names, pa.array(np.concatenate((n, total)), pa.int64())], names=["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequencies(frequent: DataFrame, limit: int = DICTIONARY, rows: int = PIVOT_ROWS) -> Frequencies:
    """The `limit` most frequent of the frequent words (lang, word, n), by rank."""
    some = frequent.orderBy(F.desc("n"), "lang", "word").limit(limit + 1).collect()
    rank: dict[str, dict[str, tuple[int, int]]] = {}
    for k, r in enumerate(some[:limit]):
        rank.setdefault(r.lang, {})[r.word] = (k, -(-r.n // rows))
    return Frequencies(rank, [r.word for r in some[:limit]], len(some) <= limit, 1 if len(some) <= limit else -(-some[limit].n // rows))


def fragments_of(langs: list[str], column: pa.Array, known: Frequencies, longest: int = LONGEST) -> pa.Table:
    """lang, pivot, parts, fragment, n: for each word, the text around it in which it is the rarest word.

    To the left stand words more frequent than it, to the right these and the word itself, each at most `longest` - 1, within
    the piece. So of the phrases that a fragment holds around its pivot, each has the pivot as its rarest word, at its first
    place; and each occurrence of a phrase is in exactly one fragment. A word outside of the dictionary is rarer than all
    within; among themselves they are ordered by their bytes. Fragments of one word are left out, equal ones counted.

    pivot: a number of its own for each word of the dictionary, a hash of language and word for others. In the fragment a tab
    stands before the pivot, a space before the other words; words of the dictionary are given by their ranks.
    """
    found = words(column, _SOLID, _BREAKS)
    names = found.vocabulary.to_pylist()
    n = len(found.ids)
    row = found.rows()
    lang_names = sorted(set(langs))
    lang_of = np.array([lang_names.index(x) for x in langs], np.int32)[row] if n else np.zeros(0, np.int32)
    rank, parts, pivot = np.full(n, -1), np.ones(n, np.int64), np.zeros(n, np.int64)
    order = np.zeros(0, np.int64)
    if not known.whole:
        order = np.empty(len(names), np.int64)
        order[sorted(range(len(names)), key=lambda i: names[i].encode())] = np.arange(len(names))
    for k, lang in enumerate(lang_names):
        own = known.rank.get(lang, {})
        each = [own.get(x) for x in names]
        ranks = np.array([-1 if e is None else e[0] for e in each], np.int64)
        numbers = ranks
        if not known.whole:
            numbers = np.array([xxhash.xxh3_64_intdigest(f"{lang}\t{x}") >> 1 | 1 << 62 if e is None else e[0] for x, e in zip(names, each, strict=True)], np.int64)
            ranks = np.where(ranks < 0, (1 << 40) + order, ranks)
        here = lang_of == k
        ids = found.ids[here]
        rank[here], pivot[here] = ranks[ids], numbers[ids]
        parts[here] = np.array([known.rest if e is None else e[1] for e in each], np.int64)[ids]
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for side, step in ((left, -1), (right, 1)):
        going = rank >= 0
        for d in range(1, min(longest, n)):
            there = np.zeros(n, bool)
            a, b = (slice(d, None), slice(None, -d)) if step < 0 else (slice(None, -d), slice(d, None))
            there[a] = (found.piece[a] == found.piece[b]) & (rank[b] >= 0) & (rank[b] < rank[a] + (step > 0))
            going &= there
            side += going
    at = np.flatnonzero(left + right > 0)
    spelled, begin = _coded(found.vocabulary, found.ids, np.where(rank < 1 << 40, rank, -1))
    lo, hi = begin[at - left[at]], begin[at + right[at] + 1]
    texts = _cut(spelled, lo, hi, begin[at] - lo)
    whole = pa.table({"lang": pa.array(lang_of[at]), "pivot": pa.array(pivot[at]), "parts": pa.array(parts[at]), "fragment": texts})
    counted = whole.group_by(whole.column_names).aggregate([([], "count_all")]).rename_columns([*whole.column_names, "n"])
    return counted.set_column(0, "lang", pa.array(lang_names, pa.string()).take(counted.column("lang").combine_chunks()))


def _coded(vocabulary: pa.Array, ids: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, each after a space, as bytes: the digits of its rank, the low ones first, or the word; and where each space is."""
    base = len(_DIGITS)
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int64)[: len(vocabulary) + 1] if len(vocabulary) else np.zeros(1, np.int64)
    known = rank >= 0
    size = np.ones(len(ids), np.int64)
    for k in range(1, 4):
        size += rank >= base**k
    size[~known] = 1 + np.diff(offsets)[ids[~known]]
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(int(begin[-1]), 32, np.uint8)
    for k in range(4):
        some = np.flatnonzero(known & (size > k))
        out[begin[some] + 1 + k] = _DIGITS[rank[some] // base**k % base]
    rest = np.flatnonzero(~known)
    if len(rest):
        out[begin[rest] + 1] = _SPELLED
        out[_places(begin[rest] + 2, size[rest] - 1)] = np.frombuffer(vocabulary.buffers()[2], np.uint8)[_places(offsets[ids[rest]], size[rest] - 1)]
    return out, begin


def _decoded(token: str, names: list[str]) -> str:
    if ord(token[0]) == _SPELLED:
        return token[1:]
    base = len(_DIGITS)
    return names[sum(int(np.searchsorted(_DIGITS, ord(c))) * base**k for k, c in enumerate(token))]


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    at = np.cumsum(size) - size
    return np.repeat(first - at, size) + np.arange(int(size.sum()))


def _cut(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, tab: np.ndarray | None = None) -> pa.Array:
    """The strings data[lo:hi], with a tab at the place `tab` of each if given."""
    at = np.concatenate(([0], np.cumsum(hi - lo))).astype(np.int64)
    gathered = data[_places(lo, hi - lo)]
    if tab is not None:
        gathered[at[:-1] + tab] = 9
    return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(at), pa.py_buffer(gathered)).cast(pa.string())


def fragments(texts: DataFrame, known: Frequencies, longest: int = LONGEST) -> DataFrame:
    """(route, lang, fragment, n): the route is a hash of the pivot and of its part, and odd where the pivot has several.

    A pivot's fragments are dealt to its parts in turns, so that a part has as many rows as any other, whatever is alike.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in slices(batches, limit=SLICE_BYTES):
            t = fragments_of(batch.column("lang").to_pylist(), batch.column("text"), shared.value, longest)
            pivot, parts = (np.asarray(t.column(c)).astype(np.uint64) for c in ("pivot", "parts"))
            part = (np.arange(len(t), dtype=np.uint64) + np.uint64(turn)) % parts
            route = (mix(mix(pivot) + part) >> np.uint64(34)).astype(np.int32) * 2 + (parts > 1)
            turn += len(t)
            out = pa.table({"route": pa.array(route.astype(np.int32)), "lang": t.column("lang"), "fragment": t.column("fragment"), "n": t.column("n").cast(pa.int32())})
            yield from out.take(pa.array(np.argsort(route, kind="stable"))).combine_chunks().to_batches()  # like rows together: they compress well

    return texts.mapInArrow(run, "route int, lang string, fragment string, n int")


def mine(routes: np.ndarray, langs: pa.Array, column: pa.Array, n: np.ndarray, names: list[str], support: int = SUPPORT, longest: int = LONGEST) -> pa.RecordBatch:
    """(lang, phrase, n): the phrases around the pivots of whole routes, those of a whole pivot only if they are frequent.

    Phrases grow from the pivot by a word to the left or right. One can only be frequent if what it grew from is, on both
    sides, so each step goes on with the fragments that passed. A phrase's number comes from that of the shorter one and the
    new word, so equal numbers are equal phrases.
    """
    found = words(column, byte_set(b" \t", invert=True), byte_set(b"\t"))
    bounds = found.bounds
    first = np.concatenate((found.piece[:1] >= 0, (np.diff(found.piece) > 0) & (np.diff(found.rows()) == 0)))
    data, offsets = utf8(column)
    first[bounds[:-1]] = data[offsets[:-1]] == 9  # the pivot is the first word
    place = np.flatnonzero(first)
    left, right = place - bounds[:-1], bounds[1:] - 1 - place
    split = routes % 2 == 1
    span = max(len(found.vocabulary), 1)
    coded = langs.dictionary_encode()
    _, route = np.unique(routes.astype(np.int64) * len(coded.dictionary) + np.asarray(coded.indices), return_inverse=True)
    number = {(0, 0): route * span + found.ids[place]}
    alive = {(0, 0): np.ones(len(place), bool)}
    outs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for size in range(1, longest):
        for a in range(size + 1):
            b = size - a
            ok = (left >= a) & (right >= b)
            for less in ((a - 1, b), (a, b - 1)):
                if min(less) >= 0:
                    ok &= alive[less]
            at = np.flatnonzero(ok)
            word, shorter = (found.ids[place[at] - a], (a - 1, b)) if a else (found.ids[place[at] + b], (a, b - 1))
            _, one, which = np.unique(number[shorter][at] * span + word, return_index=True, return_inverse=True)
            total = np.bincount(which, n[at], len(one)).astype(np.int64)
            good = (total >= support) | split[at[one]]
            number[a, b] = np.zeros(len(place), np.int64)
            number[a, b][at] = which
            alive[a, b] = np.zeros(len(place), bool)
            alive[a, b][at] = good[which]
            example = at[one[good]]
            outs.append((place[example] - a, np.full(len(example), size + 1), total[good], example))
    first_word, size, total, example = (np.concatenate(x) for x in zip(*outs, strict=True))
    own = found.ids[_places(first_word, size)]
    vocabulary = pa.array([_decoded(x, names) for x in found.vocabulary.to_pylist()], pa.large_string())
    spelled, begin = _spelled(vocabulary, own)
    ends = np.cumsum(size)
    phrases = _cut(spelled, begin[ends - size] + 1, begin[ends])
    return pa.RecordBatch.from_arrays([langs.take(pa.array(example)), phrases, pa.array(total)], names=["lang", "phrase", "n"])


def _spelled(vocabulary: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each after a space, as bytes; and where each space is (one more at the end)."""
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int64)[: len(vocabulary) + 1]
    long = np.diff(offsets)[ids]
    begin = np.concatenate(([0], np.cumsum(long + 1)))
    out = np.full(int(begin[-1]), 32, np.uint8)
    out[_places(begin[:-1] + 1, long)] = np.frombuffer(vocabulary.buffers()[2], np.uint8)[_places(offsets[ids], long)]
    return out, begin


def mined(pieces: DataFrame, known: Frequencies, support: int = SUPPORT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, a): the phrases of two words or more that occur `support` times, from the fragments.

    Fragments go to the partition of their route, where they come sorted by it; a task mines about CHUNK_ROWS of them at a
    time, whole routes only. A route has the fragments of a pivot, or of one of its parts, of about PIVOT_ROWS rows. What a
    whole pivot has counted is final, and too rare phrases end there; the counts of a split pivot are added up.
    """

    names = pieces.sparkSession.sparkContext.broadcast(known.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _whole_routes(batches):
            yield mine(np.asarray(chunk.column("route")), chunk.column("lang"), chunk.column("fragment"), np.asarray(chunk.column("n")), names.value, support, longest)

    own = pieces.repartition("route").sortWithinPartitions("route").mapInArrow(run, "lang string, phrase string, n long")
    return own.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= support)


def _whole_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by route, put together to about CHUNK_ROWS rows and cut between routes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK_ROWS:
            routes = np.concatenate([np.asarray(b.column("route")) for b in held])
            last = int(np.searchsorted(routes, routes[-1]))  # where the last route begins
            if last:
                whole = pa.concat_batches(held)
                yield whole.slice(0, last)
                held, size = [whole.slice(last)], len(routes) - last
    if held:
        yield pa.concat_batches(held)


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of two words or more: by the cut with the lowest score, the first of ties.

    `counts` has every phrase that is frequent, single words included, so it has the parts of each. Products are
    decimals of 38 digits; the score itself is at most 1000 * n / l, a long.
    """
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    word = F.split("phrase", " ")
    phrases = counts.withColumn("_words", word).where(F.size("_words") > 1)
    cuts = phrases.select("lang", "phrase", "a", "_words", F.explode(F.sequence(F.lit(1), F.size("_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("_words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("_words", F.col("k") + 1, F.size("_words")), " ").alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    joined = cuts.join(heads.hint("merge"), ["lang", "head"]).join(tails.hint("merge"), ["lang", "tail"]).join(totals, "lang")
    product = (1000 * F.col("a")).cast("decimal(19,0)") * whole("n")
    joined = joined.withColumns({"_top": product, "_bottom": whole("l") * whole("r")}).withColumn("score", F.expr("_top div _bottom"))
    best = joined.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def contained(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the count of the most frequent phrase that is one word longer, for each that has any.

    A phrase within a longer one of the same count is also within one that is a single word longer and has that count.
    """
    word = F.split("phrase", " ")
    longer = counts.withColumn("_words", word).where(F.size("_words") > 2)
    cut = F.array(F.array_join(F.slice("_words", F.lit(1), F.size("_words") - 1), " "), F.array_join(F.slice("_words", F.lit(2), F.size("_words") - 1), " "))
    return longer.select("lang", F.explode(cut).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, dictionary: int = DICTIONARY, rows: int = PIVOT_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score, then a, then the phrase's bytes.

    Words are runs without spaces and tabs, within pieces that end at .,;:!? or a line's end, A-Z in lower case. Words are
    counted first; the most frequent ones are broadcast (at most 2^17; a plain text's order of frequency needs no more: any
    other word counts as rarer). Each word's surroundings in which it is the rarest go to that word's partition, hot words to
    several, and phrases are counted there. The rest works on frequent phrases alone. A phrase within a longer one that is as
    frequent is left out. Ranks come in two steps, so no task sorts a whole language.

    Null and empty texts have no words; a null lang is `und`; repeated documents count each; an empty table gives no rows.
    Further columns are not read.
    """
    texts = texts_of(docs)
    counted = checkpointed(word_counts(texts).where(F.col("word").isNull() | (F.col("n") >= support)))
    totals = checkpointed(counted.where(F.col("word").isNull()).select("lang", "n"))
    frequent = counted.where(F.col("word").isNotNull())
    known = frequencies(frequent, dictionary, rows)
    phrases = mined(fragments(texts, known, longest), known, support, longest)
    counts = checkpointed(phrases.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))))
    few = totals.count() <= LANGUAGES
    found = scored(counts, F.broadcast(totals) if few else totals).join(contained(counts).hint("merge"), ["lang", "phrase"], "left")
    found = found.where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    last = first.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, w[i : i + m - 1] AS g
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE len(w) >= m)),
counts AS (SELECT lang, m, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {SUPPORT}),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
cuts AS (SELECT lang, m, g, a, unnest(range(1, m)) AS k FROM counts WHERE m > 1),
scores AS (
  SELECT c.lang, c.m, c.g, c.a, k, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[:k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS b FROM scores) WHERE b = 1),
longer AS (
  SELECT lang, g, max(a) AS longer
  FROM (SELECT lang, g[:m - 1] AS g, a FROM counts WHERE m > 2 UNION ALL SELECT lang, g[2:] AS g, a FROM counts WHERE m > 2) GROUP BY lang, g),
ranked AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank
  FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.g = b.g WHERE longer IS NULL OR longer < a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
