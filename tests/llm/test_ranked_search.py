import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from fixtures import SCHEMA, awkward
from tensorloom.llm import ranked_search as rs
from test_decontamination import plain_words

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences  # noqa: E402


def plain(docs, items, top):
    """[(item, rank, doc_id, score)] by scoring every document for every item."""
    counts = [(d, Counter(plain_words(t))) for d, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            if c:
                m = 75 + 25 * sum(c.values()) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_words(text) if t in c)
                if s > 0:
                    scored.append((-s, d is None, d, s))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, d, s) for k, (_, _, d, s) in enumerate(scored[:top])]
    return sorted(out, key=repr)


def corpus(rng):
    pool = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["É", "漢字", "The", "the"]
    docs = [(rng.randint(0, 300), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 80)))) for _ in range(250)]
    return docs + [(r[0], r[1]) for r in awkward()], [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(25)] + [(50, None), (51, "same text here same"), (None, "w1 w2")]


def test_equals_scoring_every_document(spark, monkeypatch):
    docs, items = corpus(random.Random(2))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items, 7)
    for limit in (rs.BLOCK_BYTES, 200):
        got = sorted((tuple(r) for r in rs.search(rs.build_index(df), bench, 7, limit).collect()), key=repr)
        assert got == want
    assert max(r for _, r, _, _ in want) == 7 and len({s for *_, s in want}) < len(want)  # with ties


def test_small_shards_give_the_same(spark):
    docs, items = corpus(random.Random(3))
    whole = [(d, t) for d, t in docs if d is not None]
    rows = []
    for at in range(0, len(whole), 9):
        part = whole[at : at + 9]
        import pyarrow as pa

        cols = rs.shard(pa.array([d for d, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string()))
        rows.append(tuple(c[0].as_py() for c in cols))
    index = spark.createDataFrame([(*r[:-1], bytearray(r[-1])) for r in rows], rs.INDEX)
    got = sorted((tuple(r) for r in rs.search(index, spark.createDataFrame(items, "item_id long, text string"), 5).collect()), key=repr)
    assert got == plain(whole, items, 5)


def test_numbers_come_back():
    rng = np.random.default_rng(0)
    numbers = np.concatenate([rng.integers(0, 1 << k, 50) for k in (1, 7, 8, 14, 15, 31, 50, 62)] + [[0, 127, 128, 16383, 16384]]).astype(np.int64)
    data, size = rs.packed(numbers)
    assert len(data) == size.sum() and (rs.unpacked(data) == numbers).all()
    assert len(rs.unpacked(rs.packed(np.zeros(0, np.int64))[0])) == 0


def test_awkward_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "same text"), (1, "same text")], "item_id long, text string")
    docs = spark.createDataFrame(awkward(), SCHEMA)
    assert rs.search(rs.build_index(docs), none).count() == 0
    assert rs.search(rs.build_index(spark.createDataFrame([], SCHEMA)), items).count() == 0
    got = [r.doc_id for r in rs.search(rs.build_index(docs), items).where("item_id = 1").orderBy("rank").collect()]
    assert Counter(got)[8] == 4 and Counter(got)[7] == 2


def test_query_equals_sql(spark, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        assert differences(rs.query(spark, folder), rs.ORACLE, folder) == []
