import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np

from fixtures import SCHEMA, awkward
from tensorloom.llm import decontamination as dec

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    """(n_words, n_hit, ids) of each document, window by window."""
    windows = []
    for name, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        windows += [("" if name is None else str(name), w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for text in docs:
        w = plain_words(text)
        hit, names = set(), set()
        for name, g in windows:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit |= {*range(i, i + len(g))}
                    names.add(name)
        out.append((len(w), len(hit), sorted(names)))
    return out


def sample(rng):
    pool = ["alpha", "Beta", "gamma", "delta", "épée", "漢字", "x1"]
    phrase = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, phrase(rng.choice([1, 3, 4, 6, 9, 10, 11, 14]) if i % 3 else 12)) for i in range(40)] + [(7, phrase(12)), (None, "only once here and nowhere else"), (99, None), (98, ""), (97, "...")]
    docs = [phrase(rng.randint(0, 60)) for _ in range(60)]
    docs += [f"{phrase(8)}, {t.upper() if t else ''}! {phrase(3)}" for _, t in items]
    return [x for x in items if len(plain_words(x[1])) != 1], docs + [r[1] for r in awkward()]


def test_equals_the_plain_search(spark):
    items, docs = sample(random.Random(5))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "'x' AS items", "1 AS n_words")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert sum(n > 0 for _, n, _ in want) > 20
    for limit in (dec.BLOCK_BYTES, 400):  # in one block, and in several
        marked = dec.decontaminate(df, bench, limit)
        spans = {r.doc_id: (r.n_words, sum(b - a for a, b in zip(r.hit_starts, r.hit_ends, strict=True)), r["items"]) for r in marked.collect()}
        assert spans == dict(enumerate(want))
        for r in dec.digest(marked).collect():
            n, hit, names = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_every_shared_span_has_a_fingerprint():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 300).astype(np.uint64)
    for n in range(1, 11):
        b[50 : 50 + n] = a[100 : 100 + n]
        assert set(dec.winnowed(a, n).tolist()) & set(dec.winnowed(b, n).tolist())


def test_awkward_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, awkward()[4][1]), (2, "same text here")], "item_id long, text string")
    got = dec.digest(dec.decontaminate(docs, none)).collect()
    assert len(got) == len(awkward()) and not any(r.contaminated for r in got)
    marked = {(r.doc_id, r.n_hit) for r in dec.digest(dec.decontaminate(docs, some)).collect() if r.contaminated}
    assert marked == {(5, 30_000), (7, 3), (8, 3)}
    assert dec.decontaminate(spark.createDataFrame([], SCHEMA), some).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(dec.query(spark, sf_dir), dec.ORACLE, sf_dir) == []
    assert dec.query(spark, sf_dir).where("contaminated").count() > 0
