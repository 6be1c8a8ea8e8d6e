import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

from tokenizers import Tokenizer

import corpus_pipeline
from brute import WORD, near_duplicates
from fixtures import SCHEMA, awkward
from tensorloom.llm import secret_scan, toxicity
from tensorloom.llm.mixing import ORACLE
from tensorloom.llm.mixing import query as mix_query
from tensorloom.llm.tokens import default_path
from test_secrets_quality import base

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import database  # noqa: E402


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    everything = ids(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
            assert ids(docs) == sorted(d for d, s in scores.items() if s < 0.3)
            assert len(ids(docs)) > 0.7 * len(everything)
        elif name == "near_duplicates":
            groups = near_duplicates([(r.doc_id, r.text) for r in before.collect()], 80)
            assert ids(docs) == sorted({c for _, c in groups.values()})
        elif name == "secrets":
            assert ids(docs) == ids(before)
            old = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                found = base(old[r.doc_id])
                assert all(old[r.doc_id][a:b] not in r.text for a, _, b in found)
                if not found and not secret_scan.Index().scan(__import__("pyarrow").array([old[r.doc_id]]))[0]:
                    assert r.text == old[r.doc_id]
                assert r.n_chars == len(r.text)
        elif name == "mixing":
            sizes = {r.doc_id: len(WORD.findall(r.text)) for r in before.collect()}
            taken = defaultdict(int)
            for r in docs.collect():
                taken[r.doc_id] += len(WORD.findall(r.text))
            before.write.parquet(str(tmp_path / "mix" / "documents.parquet"))
            want = {r.doc_id: r.taken for r in mix_query(spark, str(tmp_path / "mix")).collect() if r.taken}
            assert dict(taken) == want and all(n <= 3 * sizes[d] for d, n in taken.items())
        else:
            windows = defaultdict(int)
            for r in docs.collect():
                windows[r.sequence_id] += r.length
                assert len(r.ids) == r.length
            assert max(windows.values()) <= 4096
            by_doc = defaultdict(int)
            for r in docs.collect():
                by_doc[r.doc_id] += r.length
            assert set(by_doc) == set(ids(before))


def plain_spans(text):
    """Every rule's pattern on the whole text, without the index."""
    return sorted((m.start(), k, m.end()) for k, r in enumerate(secret_scan.RULES) for m in re.finditer(r.pattern, text) if r.keep(m))


def small_corpus():
    """Prose of several sources with near copies, secrets, words of the toxic documents, and awkward rows; ids are distinct."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "ne", "su", "ko") for b in ("la", "mi", "to", "ver", "n", "sh")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(20, 120):
        text, toxic = prose(rng.randint(3, 120)), i % 5 == 0
        if toxic:
            text = " ".join(f"{w} vile scum" for w in text.split()[:30])
        elif i % 7 == 1:
            text += " password: hunter" + str(i) + "22 and AKIA" + "Q" * 16
        rows.append((i, text, "en", rng.choice(["hot", "hot", "hot", "b", None]), len(text), 1, 0.0, ""))
        labels.append((i, 1, int(toxic)))
        if i % 9 == 0 and not toxic:
            near = text + " end" if len(text.split()) > 40 else text
            rows.append((i + 1000, near, "en", "b", len(near), 1, 0.0, ""))
    seen = {None}
    for r in awkward():
        if r[0] not in seen:
            rows.append(r)
            seen.add(r[0])
    return rows, labels


def test_run_equals_plain_python(spark, tmp_path):
    """All five stages at once: the ids of all pieces, document by document, from a plain version of each stage."""
    rows, labels = small_corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, marks = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    kept = [r for r in rows if scores[r[0]] < 0.3]
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    assert {i for i, _, toxic in labels if toxic} <= gone and len(gone) < 40
    roots = near_duplicates([r[:2] for r in kept], 80)
    alone = [r for r in kept if roots[r[0]][1] == r[0]]
    assert 5 < len(kept) - len(alone) < 20
    clean = [(d, t if t is None else secret_scan.redact(t, plain_spans(t)), lang, src) for d, t, lang, src, *_ in alone]
    spark.createDataFrame(clean, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "mix" / "documents.parquet"))
    taken = database(str(tmp_path / "mix")).execute(f"SELECT doc_id, size, taken FROM ({ORACLE})").fetchall()
    tok, texts, want = Tokenizer.from_file(default_path("word_bpe_49k.json")), {d: t for d, t, *_ in clean}, {}
    for d, size, n in taken:
        if n:
            part = "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", texts[d])[: n % size])
            copies = [texts[d]] * (n // size) + [part] * (n % size > 0)
            want[d] = Counter(t for c in copies for t in [*tok.encode(c, add_special_tokens=False).ids, 2])
    got, windows = defaultdict(Counter), defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].update(r.ids)
        windows[r.sequence_id] += r.length
    assert dict(got) == want and max(windows.values()) <= 4096
    assert not any("hunter" in (t or "") for t in texts.values())


def test_awkward_rows_pass(spark, tmp_path):
    """Repeated and missing ids too: what is left of each row goes on."""
    spark.createDataFrame(awkward(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1), (5, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, marks = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, marks)).where("score >= 0.3").collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) <= {r[0] for r in awkward()} - toxic - {2, 3, 4, 8}  # no words, or a copy of 7
    assert 5 in got or 5 in toxic


def test_empty_tables_pass(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
