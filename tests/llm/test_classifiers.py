import random
import re

import numpy as np
import pyarrow as pa
import pytest

from brute import fold
from fixtures import SCHEMA, awkward
from tensorloom.llm import langid, toxicity


@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.1"


def test_toxicity_on_the_held_out_fold(spark, big):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = toxicity.query(spark, big).collect()
    assert len(got) == spark.read.parquet(f"{big}/documents.parquet").count()
    for r in got:
        assert r.held_out == (fold(r.doc_id) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(truth[r.doc_id], r.score) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    bad, good = [s for y, s in held if y], [s for y, s in held if not y]
    assert len(bad) > 10
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    caught = np.mean([b >= 0.3 for b in bad])
    wrong = np.mean([g >= 0.3 for g in good])
    assert auc > 0.9 and caught > 0.8 and wrong < 0.1, (auc, caught, wrong)


def test_toxicity_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score"]
    rows = out.collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert [r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()] == pytest.approx([0.0] * len(rows), abs=1e-9)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ftrl_against_the_plain_update():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 8)) for _ in range(60)]
    labels = np.asarray([float(3 in r or 7 in r) for r in rows])
    p = toxicity.Ftrl(l1=0.5)
    w = toxicity.fit(rows, labels, p)
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= p.l1 else -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + n.get(i, 0.0) ** 0.5) / p.alpha + p.l2)
    for _ in range(p.epochs):
        for r, y in zip(rows, labels, strict=True):
            i = [*r.tolist(), 1 << toxicity.BITS]
            now = {k: weight(k) for k in i}
            g = 1 / (1 + np.exp(-sum(now.values()))) - y
            for k in i:
                sigma = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / p.alpha
                z[k] = z.get(k, 0.0) + g - sigma * now[k]
                n[k] = n.get(k, 0.0) + g * g
    assert np.allclose([w[k] for k in z], [weight(k) for k in z])
    assert (w != 0).sum() <= len(z)


def test_language_on_the_held_out_fold(spark, big):
    docs = spark.read.parquet(f"{big}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()}
    got = langid.query(spark, big).collect()
    assert len(got) == len(truth)
    right = [r.lang_pred == truth[r.doc_id][0] for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean(right) > 0.95
    for r in got:
        lettered = any(c.isalpha() for c in truth[r.doc_id][1] or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1 and r.held_out == (fold(r.doc_id) == 2)


def test_language_awkward_rows(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    model = langid.train(docs)
    assert set(model[0]) <= {"en", "fr", "de", "es"}
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_posterior_against_plain_sums(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("le chat noir", "fr"), ("the dog and the cat", "en"), ("un chien et le chat", "fr")] * 5)], "doc_id long, text string, lang string")
    langs, logs = langid.train(docs)
    text = "The chat"
    slots, _ = langid.ngram_slots([text])
    total = logs[-1] + sum(logs[s] for part in slots for s in part)
    p = np.exp(total - total.max())
    row = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), (langs, logs)).first()
    assert row.lang_pred == langs[total.argmax()] and np.isclose(row.score, p.max() / p.sum())


def _texts(n=120):
    rng = random.Random(4)
    words = ["Alpha", "beta", "don't", "naïve", "x", "b*d", "état", "A1", "漢字", "ÄÖ"]
    return ["", " ", "one", *("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ", ", ". ", "\t"]) for _ in range(rng.randint(1, 40))) for _ in range(n)), "Word" * 30 + " tail"]


def _same_parts(plain, slots):
    """Equal groups have equal slots, and nearly all different ones have different slots."""
    assert len(plain) == len(slots)
    seen = {}
    for group, slot in zip(plain, slots, strict=True):
        assert seen.setdefault(group, slot) == slot
    assert len(set(seen.values())) >= 0.98 * len(seen)


def test_toxicity_features_are_the_plain_groups():
    """Single words, neighbours and words two and three apart, spelled out: no group missing, added, or over a text's end."""
    texts = _texts()
    slots, row = toxicity.features(pa.array(texts))
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = [re.findall(r"(?:[a-z0-9'*@$-]|[^\x00-\x7f])+", lower(t)) for t in texts]
    plain = [(d, w[i], w[i + d], r) for d in range(4) for r, w in enumerate(words) for i in range(len(w) - d)]
    assert row.tolist() == [r for *_, r in plain]
    _same_parts([(d, a, b) for d, a, b, _ in plain], slots.tolist())


def test_language_slots_are_the_plain_ngrams():
    texts = _texts()
    parts, offsets = langid.ngram_slots(texts)
    assert np.diff(offsets).tolist() == [len(t.lower()) for t in texts]
    plain, slots = [], []
    for n, part in zip(langid.LENGTHS, parts, strict=True):
        at = [t.lower()[i : i + n] for t in texts for i in range(len(t.lower()))]
        assert [len(g) == n for g in at] == (part != langid.SLOTS).tolist()
        plain += [g for g in at if len(g) == n]
        slots += part[part != langid.SLOTS].tolist()
    _same_parts(plain, slots)


def test_languages_are_bounded(spark):
    """Stray values of the column make no larger model: the most frequent languages stay, ties to the first in order."""
    rows = [(i, "the cat sat on the mat", "en") for i in range(40)] + [(100 + i, "le chat noir dort", "fr") for i in range(40)] + [(200 + i, "stray", f"x{i:03}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, _ = langid.train(docs)
    assert len(whole) > 70
    langs, logs = langid.train(docs, max_langs=3)
    assert langs == ["en", "fr", min(x for x in whole if x[0] == "x")] and logs.shape == (langid.SLOTS + 2, 3)
    few, same = langid.train(docs.where("lang in ('en', 'fr')"))
    assert few == ["en", "fr"] and np.allclose(same[: langid.SLOTS], logs[: langid.SLOTS, :2])
    assert {r.lang_pred for r in langid.predict(docs.where("doc_id < 40"), (langs, logs)).collect()} == {"en"}
