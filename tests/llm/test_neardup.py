import random

import pytest

from brute import near_duplicates as plain
from tensorloom.llm import neardup

SCHEMA = "doc_id long, text string"


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in neardup.near_duplicates(df, **kw).select("doc_id", "n_shingles", "component_id", "kept").collect()]


def family(rng, base, n, edits):
    """Copies of a text with a few words changed."""
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = ["", "   ", "one two", "ONE two", "one two three four five", None, None]
    for size, n, edits in ((200, 60, 6), (80, 40, 4), (40, 30, 2), (400, 25, 30)):
        texts += family(rng, [f"w{rng.randrange(5000)}" for _ in range(size)], n, edits)
    texts += [" ".join(f"u{rng.randrange(9000)}" for _ in range(50)) for _ in range(40)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [2048, 16])
def test_equals_all_pairs(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    want = plain(corpus)
    for doc_id, n, component, kept in found(spark, corpus):
        assert (n, component) == want[doc_id] or (n == 0 and component == doc_id)
        assert kept == (component == doc_id)


def test_driver_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    got = {d: (n, c) for d, n, c, _ in found(spark, rows)}
    assert got == want


def test_lower_threshold(spark, corpus):
    scheme = neardup.Scheme(percent=80, chunks=14, width=4)
    want = plain(corpus, 80)
    assert {d: c for d, _, c, _ in found(spark, corpus, scheme=scheme)} == {d: c for d, (_, c) in want.items()}


def test_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 9, "a"), (1, text, 9, "a"), (None, text, 9, "a"), (None, "alone in the world", 9, "b"), (2, None, 9, "c"), (3, text + " end", 9, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep long, sig string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 26, 1, True), (1, 26, 1, True), (None, 26, 1, False), (None, 1, None, True), (2, 0, 2, True), (3, 27, 1, False)], key=repr)


def test_empty_table(spark):
    assert found(spark, []) == []
