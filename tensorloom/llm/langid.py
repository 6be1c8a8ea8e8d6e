"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, held_out, slices, table, with_schema

#: Rows to learn from at most (those with the smallest hashes of their ids), languages at most (the most frequent of these
#: rows; ties: the first in order), n-gram lengths, slots per length. The model has 8 bytes a slot and language: at most 151 MB.
MAX_ROWS = 20_000
MAX_LANGS = 192
LENGTHS = (1, 2, 3)
BITS = 15
SLOTS = len(LENGTHS) << BITS
#: Bytes of text turned into numpy arrays at once.
_PIECE = 1 << 20
#: Languages that a task counts at once.
_HELD = 64


def ngram_slots(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram length the slot of the n-gram that starts at each character (SLOTS where it reaches over the text's
    end), and where each text starts. Letters in lower case, runs of other characters as they are."""
    low = [t.lower() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in low])))
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    h, out = np.full(len(points), 2166136261, np.uint32), []
    for k, n in enumerate(LENGTHS):
        m = len(points) - n + 1
        if m <= 0:
            out.append(np.full(len(points), SLOTS, np.int64))
            continue
        h = (h[:m] ^ points[n - 1 :]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        slot = np.full(len(points), SLOTS, np.int64)
        slot[:m] = ((h * np.uint32(2246822519)) >> np.uint32(32 - BITS)) + (k << BITS)
        for back in range(1, n):
            ends = offsets[1:] - back
            slot[ends[ends >= 0]] = SLOTS
        out.append(slot)
    return out, offsets


def train(docs: DataFrame, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """(languages, matrix of log probabilities: SLOTS + 2 rows, the last two for nothing and for the prior).

    Learns from a bounded sample of the rows outside the held-out fold with text and language: the `max_rows` with the
    smallest hashes of their ids, and of their languages the `max_langs` most frequent, so a column of stray values makes no
    larger model. N-grams are counted in the tasks; sums per language and slot reach the driver, at most SLOTS for each
    language that is kept. Without such rows there is no language.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(sample), "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out():
            for lang, n in sums.items():
                n[SLOTS] = 0
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "slot": pa.array(at), "n": pa.array(n[at])})
            sums.clear()

        for batch in slices(batches, limit=_PIECE):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                if lang not in sums and len(sums) >= _HELD:
                    yield from out()
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                into = sums.setdefault(lang, np.zeros(SLOTS + 2, np.int64))
                for slots in ngram_slots(own)[0]:
                    into += np.bincount(slots, minlength=SLOTS + 2)
                into[-1] += len(own)
        yield from out()

    counted = checkpointed(rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    kept = counted.where(F.col("slot") == SLOTS + 1).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang")
    found = counted.join(F.broadcast(kept), "lang").toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((SLOTS + 2, len(langs)))
    if langs:
        counts[found["slot"].to_numpy(), np.searchsorted(langs, found["lang"])] = found["n"]
    logs = np.log(counts + 0.5)
    for k in range(len(LENGTHS)):
        part = slice(k << BITS, (k + 1) << BITS)
        logs[part] -= np.log((counts[part] + 0.5).sum(axis=0))
    logs[SLOTS] = 0
    logs[-1] = np.log(np.maximum(counts[-1], 0.5) / max(1.0, counts[-1].sum()))
    return langs, logs


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """`docs` with lang_pred and score, the posterior probability of that language.

    A null text, one without a letter, and any text if nothing was learned, is `und` with score 0. Ties go to the language first in order.
    All rows and columns of `docs` stay, but for those of these names; `text` is needed. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    out = with_schema(docs, lang_pred="string", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = shared.value
        for batch in slices(batches, limit=_PIECE):
            text = pc.fill_null(batch.column("text"), "")
            lettered = np.asarray(pc.match_substring_regex(text, r"\p{L}")) & bool(langs)
            total = np.tile(logs[-1], (batch.num_rows, 1)) if langs else np.zeros((batch.num_rows, 1))
            slots, offsets = ngram_slots(text.to_pylist())
            full = np.flatnonzero(np.diff(offsets))
            if len(full) and langs:
                for part in slots:
                    for c in range(len(langs)):
                        total[full, c] += np.add.reduceat(logs[:, c].take(part), offsets[full])
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.where(lettered, p, 0.0))], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    predicted = predict(docs.select("doc_id", "text"), train(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


ORACLE = None
