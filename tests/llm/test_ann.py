import numpy as np
import pytest

from tensorloom.llm import ann

KIND = "vec_id long, embedding array<float>, v string, code int"


def exact(ids, v, queries, k=5):
    """query -> [(vec_id, cosine)] nearest first, ties to the smaller id."""
    unit = np.sqrt((v**2).sum(axis=1))
    out = {}
    for q in queries:
        i = np.flatnonzero(ids == q)[0]
        score = v @ v[i] / (unit * unit[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(y) for y in x], "x", 1) for i, x in zip(ids, v, strict=True)], KIND)


def recall(df, want, k=5):
    got: dict = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    hits = total = 0
    for q, best in want.items():
        rows = got.get(q, [])
        assert [r[2] for r in rows] == list(range(1, len(best) + 1))
        scores = [r[1] for r in rows]
        assert scores == sorted(scores, reverse=True)
        hits += len({r[0] for r in rows} & {b for b, _ in best})
        total += len(best)
    return hits / max(1, total), got


@pytest.mark.parametrize("block", [4096, 300])
def test_recall_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, v = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    want = exact(ids, v, ids[ids % 50 == 0])
    share, got = recall(ann.query(spark, "/root/testdata/sf0.1"), want)
    assert share >= 0.9
    for q, rows in got.items():
        true = dict(exact(ids, v, [q], len(ids))[q])
        assert all(abs(true[i] - s) < 1e-12 for i, s, _ in rows)


def test_ties_copies_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 6)).astype(np.float32).astype(float)
    v[20:60] = v[0]  # copies of a query: the smallest ids win
    ids = np.arange(120)
    df = frame(spark, ids, v)
    extra = [(500, None, "x", 1), (550, [0.0] * 6, "x", 1), (600, [float("nan")] + [1.0] * 5, "x", 1), (650, [None] + [1.0] * 5, "x", 1), (700, [float("inf")] + [1.0] * 5, "x", 1), (750, [1.0, 2.0], "x", 1), (None, [1.0] * 6, "x", 1)]
    out = ann.nearest(df.unionByName(spark.createDataFrame(extra, KIND)), ann.F.col("vec_id") % 50 == 0)
    share, got = recall(out, exact(ids, v, ids[ids % 50 == 0]))
    assert share == 1 and [r[0] for r in got[0]] == [20, 21, 22, 23, 24] and set(got) == {0, 50, 100}


def test_full_block_with_a_third_of_near_copies(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(ann.BLOCK_ROWS, 64))
    near = np.arange(len(v)) % 3 == 0
    v[near] = v[0] + 1e-3 * rng.normal(size=(near.sum(), 64))
    v, ids = v.astype(np.float32).astype(float), np.arange(len(v))
    asked = ids[ids % 50 == 0]
    share, got = recall(ann.nearest(frame(spark, ids, v), ann.F.col("vec_id") % 50 == 0), exact(ids, v, asked))
    hits = {bool(near[q]): [] for q in asked}
    for q, best in exact(ids, v, asked).items():
        hits[bool(near[q])].append(len({i for i, _ in best} & {r[0] for r in got[q]}) / 5)
    assert share == 1, {k: np.mean(x) for k, x in hits.items()}


def test_few_rows(spark):
    v = np.eye(3)
    share, got = recall(ann.nearest(frame(spark, [0, 1, 2], v), ann.F.col("vec_id") == 0), {0: [(1, 0.0), (2, 0.0)]})
    assert share == 1 and len(got[0]) == 2
    assert ann.nearest(frame(spark, [0], v[:1]), ann.F.col("vec_id") == 0).count() == 0
    assert ann.nearest(frame(spark, [], []), ann.F.col("vec_id") == 0).count() == 0


def test_codes_lower_the_anisotropic_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 64))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    book = ann.fit(x)

    def loss(codes):
        r = book.pad(x) - book.words[np.arange(book.words.shape[0]), codes]
        parallel = (r * book.pad(x)).sum(axis=(1, 2))
        return (r**2).sum(axis=(1, 2)) + (book.eta - 1) * parallel**2

    nearest = ((book.pad(x)[:, :, None] - book.words[None]) ** 2).sum(axis=3).argmin(axis=2)
    assert (loss(book.encode(x)) <= loss(nearest) + 1e-9).all() and book.eta > 1


def test_clustered_vectors_visit_few_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.15 * rng.normal(size=(3000, 24))
    v, ids = v.astype(np.float32).astype(float), np.arange(3000)
    df = frame(spark, ids, v)
    model = ann.train(ann.usable(df), 3000)
    assert len(model.centres) == 30 and model.probes <= 10
    share, _ = recall(ann.nearest(df, ann.F.col("vec_id") % 50 == 0), exact(ids, v, ids[ids % 50 == 0]))
    assert share >= 0.95


def test_a_repeated_id_has_its_smallest_vector(spark):
    rows = [(50, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.1]), (7, None), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (50, [2.0, 0.0])]
    schema = "vec_id long, embedding array<float>"
    want = [(50, 1, 8, pytest.approx(2**-0.5)), (50, 2, 7, pytest.approx(0.0))]
    for order in (rows, rows[::-1]):
        got = ann.nearest(spark.createDataFrame(order, schema).repartition(3), ann.F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == want
