import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fixtures import SCHEMA, awkward, many
from tensorloom.llm import packing, token_io
from tensorloom.llm.tokens import PieceTokenizer, default_path

BYTE, WORDS = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")


def encoded(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def texts(spark, sf_dir):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_pieces_equal_the_whole(spark, sf_dir, path):
    tok, own = Tokenizer.from_file(path), PieceTokenizer(path)
    odd = [t for _, t, *_ in awkward() if t] + ["don't can't I'll 'tis rock'n'roll", "a.b, c;d (e) [f] 12 3,456.78 x2 2x", "naïve ÉCOLE straße İstanbul ﬁn ½ ², 3rd", "á ë ﻿ zw​sp emoji 😀 👩‍👩‍👧 x", "<|endoftext|> <|startoftext|>", "A. B.C. 'quoted' \"q\"'s it's", "...a ,b", "ÀÈ,. où", "ab\x85cd", "x\x1cy"]
    for t in odd + texts(spark, sf_dir):
        assert own.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, t[:80]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("frame", [1 << 19, 64])
def test_files_round_trip(spark, tmp_path, monkeypatch, frame):
    monkeypatch.setattr(token_io, "FRAME_IDS", frame)
    rows = awkward() + many(300, random.Random(4))
    path = str(tmp_path / "out")
    token_io.write_tokens(spark.createDataFrame(rows, SCHEMA), path, BYTE, shard_bytes=5_000)
    got = token_io.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    want, at = defaultdict(set), 0
    for d, t, *_ in rows:
        want[d].add(tuple(encoded(BYTE, t) + [0]))
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and tuple(r.ids) in want[r.doc_id] and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    (one,) = token_io.read_document(spark, path, 5)
    assert tuple(one.tolist()) in want[5]
    assert len(token_io.read_document(spark, path, 8)) == sum(r[0] == 8 for r in rows)
    assert token_io.read_document(spark, path, -1) == []


def test_parts_of_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_io, "FRAME_IDS", 2000)
    rows = many(200, random.Random(8))
    path = str(tmp_path / "out")
    token_io.write_tokens(spark.createDataFrame(rows, SCHEMA), path, BYTE, shard_bytes=8_000)
    for d, t, *_ in rows[::37]:
        want = encoded(BYTE, t) + [0]
        for start, stop in ((0, 1), (3, 9), (len(want) - 2, None), (0, None), (5, 5), (0, 10**6)):
            (got,) = token_io.read_document(spark, path, d, start, stop)
            assert got.tolist() == want[max(0, start) : stop]


def plain_repair(seq, min_count):
    """One pair after the other, the most frequent first; (symbols, rules)."""
    rules = []
    while True:
        count, before = Counter(), None
        for p in zip(seq, seq[1:]):
            before = None if p == before else p  # of a run of one symbol every other pair counts
            count[p] += before is not None
        if not count or max(count.values()) < min_count:
            return seq, rules
        best = min(p for p in count if count[p] == max(count.values()))
        out, i = [], 0
        while i < len(seq):
            both = tuple(seq[i : i + 2]) == best
            out.append((1 << 20) + len(rules) if both else seq[i])
            i += 1 + both
        rules.append(best)
        seq = out


@pytest.mark.parametrize("seed", range(4))
def test_repair_against_the_plain_one(seed):
    """As small as by single pairs (within 5 %), and no pair is left that would pay."""
    rng = random.Random(seed)
    words = [[rng.randrange(60) for _ in range(rng.randint(1, 7))] for _ in range(40)]
    seq = [x for _ in range(700) for x in words[min(rng.randrange(40), rng.randrange(40))]]
    ids = np.asarray(seq, "<u4")
    symbols, _, rules = token_io.repair(ids, np.asarray([len(ids)]), 1 << 20)
    assert (token_io.expand(symbols, rules, 1 << 20) == ids).all()
    want, grammar = plain_repair(seq, token_io.MIN_COUNT)
    assert len(symbols) + 4 * len(rules) <= 1.05 * (len(want) + 4 * len(grammar))
    assert plain_repair(symbols.tolist(), token_io.MIN_COUNT)[1] == []


def test_repair_compresses_and_expands():
    rng = np.random.default_rng(1)
    for ids in (np.tile([5, 6, 7, 8], 500), np.full(1001, 3), rng.integers(0, 4, 3000), np.asarray([1]), np.zeros(0, int)):
        ids = ids.astype("<u4")
        ends = np.asarray([0, len(ids) // 3, len(ids)], np.int64)
        symbols, stops, rules = token_io.repair(ids, ends, 1 << 20)
        assert (token_io.expand(symbols, rules, 1 << 20) == ids).all()
        first = token_io.expand(symbols[: stops[1]], rules, 1 << 20)
        assert (first == ids[: ends[1]]).all()
        if len(ids) > 1000:
            assert len(symbols) <= len(ids) / 2
        for k, pair in enumerate(rules):
            assert (pair < (1 << 20) + k).all()


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    token_io.write_tokens(none, str(tmp_path / "none"), BYTE)
    assert token_io.read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert packing.pack(none, WORDS).count() == 0


@pytest.mark.parametrize("waiting", [4 << 20, 3000])
def test_packing(spark, monkeypatch, waiting):
    monkeypatch.setattr(packing, "OPEN_IDS", waiting)
    rows = awkward() + many(400, random.Random(6))
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), WORDS, window=256).collect()
    want = defaultdict(list)
    for d, t, *_ in rows:
        want[d].append(encoded(WORDS, t) + [2])
    by_doc, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == crc(p.ids)
        by_doc[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    for d, docs in want.items():
        assert sum(p.length for p in by_doc[d]) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for p in sorted(by_doc[d], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(docs[0]) and p.ids == docs[0][at : at + p.length]
                at += p.length
            assert at == len(docs[0])
    partial = 0
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
        partial += at < 256
    assert partial <= 3 if waiting > 10_000 else partial < len(windows)


def test_sum_of_squares_picks_the_least():
    bins = packing.SumOfSquares(10)
    rng = random.Random(0)
    for k in range(500):
        size = rng.randint(1, 9)
        before = bins.count.copy()
        costs = {}
        for level in range(0, 10 - size + 1):
            if level and not before[level]:
                continue
            after = before.copy()
            after[level] -= level > 0
            if level + size < 10:
                after[level + size] += 1
            costs[level] = int((after[1:10] ** 2).sum())
        full = bins.place(k, 0, size)
        assert int((bins.count[1:10] ** 2).sum()) == min(costs.values())
        assert full is None or sum(p[2] for p in full) == 10


def test_shards_grow_with_the_bytes_of_text(spark, tmp_path):
    rows = [(i, "word " * 200, "en", "a", 0, 0, 0.0, "") for i in range(64)]
    docs = spark.createDataFrame(rows, SCHEMA)

    def shards(name, **sizes):
        token_io.write_tokens(docs, str(tmp_path / name), BYTE, **sizes)
        return spark.read.parquet(str(tmp_path / name)).select("shard").distinct().count()

    assert shards("bytes", shard_bytes=8_000, least_bytes=1 << 20) == 8
    assert shards("tasks", shard_bytes=1 << 30, least_bytes=1_000) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shards("one") == 1
