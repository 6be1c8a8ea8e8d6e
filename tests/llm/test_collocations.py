import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from fixtures import SCHEMA, awkward
from tensorloom.llm import collocations as col

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differences  # noqa: E402


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(rows, support, top):
    """The ranked phrases, by counting every phrase of every piece."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        for p in pieces(text):
            total[lang or "und"] += len(p)
            f.update((lang or "und", *p[i : i + m]) for m in range(1, 6) for i in range(len(p) - m + 1))
    out = []
    for lang in total:
        found = []
        cands = [k for k, a in f.items() if k[0] == lang and a >= support and len(k) > 2]
        for key in cands:
            p, a = key[1:], f[key]
            inside = lambda q: any(q[1:][i : i + len(p)] == p for i in range(len(q) - len(p)))
            if any(len(q) > len(key) and f[q] >= a and inside(q) for q in cands):
                continue
            s, _, left, right = min((1000 * a * total[lang] // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, le, r, total[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.8))}" for _ in range(60)] + ["É", "漢字", "New", "york", "a", "a"]
    fixed = ["New york City hall opens", "a a a a a a", "of the of the of", "É 漢字 x"]
    rows = []
    for _ in range(150):
        bits = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(b + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for b in bits)))
    return rows + [(r[2], r[1]) for r in awkward()]


@pytest.mark.parametrize("dictionary, rows", [(1 << 17, 1 << 16), (1 << 17, 3), (5, 4), (1, 1 << 16), (0, 7)])
def test_equals_counting_every_phrase(spark, dictionary, rows):
    """With the whole dictionary, pivots in parts, and dictionaries that hold few words or none."""
    data = corpus(4)
    df = spark.createDataFrame(data, "lang string, text string").selectExpr("*", "1 AS n", "'x' AS phrase").repartition(3)
    got = sorted(tuple(r) for r in col.collocations(df, support=6, top=25, dictionary=dictionary, rows=rows).collect())
    want = plain(data, 6, 25)
    assert got == want
    assert {r[0] for r in got} == {"en", "de", "und"} and max(len(r[2].split(" ")) for r in got) == 5


def test_each_occurrence_is_in_one_fragment():
    text = "a b a c a b a d, a a a a a a b"
    known = col.Frequencies({"en": {"a": (0, 1), "b": (1, 1), "c": (2, 1)}}, ["a", "b", "c"], True, 1)
    made = Counter()
    ranks = {"a": 0, "b": 1, "c": 2}
    for r in col.fragments_of(["en"], pa.array([text]), known).to_pylist():
        before, _, after = r["fragment"].partition("\t")
        w, at = [col._decoded(x, known.names) for x in (before + " " + after).split()], len(before.split())
        assert ranks[w[at]] == r["pivot"] and w[at] not in w[:at]
        for i in range(at + 1):
            for j in range(max(at, i + 1), min(len(w), i + 5)):
                made[tuple(w[i : j + 1])] += r["n"]
    want = Counter()
    for p in ("a b a c a b a".split(), "a a a a a a b".split()):
        want.update(tuple(p[i : i + m]) for m in range(2, 6) for i in range(len(p) - m + 1))
    assert made == want


def test_codes_of_ranks_come_back():
    rank = np.array([0, 67, 68, 4623, 4624, 131071, -1, 5])
    data, begin = col._coded(pa.array(["ab", "漢"], pa.large_string()), np.array([0, 0, 0, 0, 0, 0, 1, 1]), rank)
    tokens = data.tobytes().decode().split()
    assert [col._decoded(t, [str(i) for i in range(1 << 17)]) for t in tokens] == ["0", "67", "68", "4623", "4624", "131071", "漢", "5"] and len(begin) == 9


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", "x y", big), ("en", "x", big + 1), ("en", "y", big + 3)], "lang string, phrase string, a long")
    row = col.scored(counts, spark.createDataFrame([("en", 9 * big)], "lang string, n long")).first()
    assert row.score == 1000 * big * 9 * big // ((big + 1) * (big + 3))


def test_awkward_rows_and_empty_tables(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    data = [(r[2], r[1]) for r in awkward()]
    got = sorted(tuple(r) for r in col.collocations(spark.createDataFrame(awkward(), SCHEMA), support=3).collect())
    assert got == plain(data, 3, 2000)


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(col.query(spark, sf_dir), col.ORACLE, sf_dir) == []
    assert col.query(spark, sf_dir).count() > 50
