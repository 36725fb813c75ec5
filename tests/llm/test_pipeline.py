"""The pipeline's stages on a small table: each works on its input, and its decisions take effect."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    from tarmac.llm.common import Workspace

    ws = Workspace(spark, "test")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.write(stage(spark, docs, DATA))
        if name != "packing":
            assert docs.columns == columns
            n = docs.count()
            assert 0 < n <= before
            before = n
    assert docs.select("doc_id").distinct().count() == before
    lengths = {r["sequence_id"]: r["n"] for r in docs.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())


def planted(spark):
    """Documents with near copies, shared passages, junk, nulls, repeats and columns that stages use inside."""
    import random

    r = random.Random(21)
    words = [f"word{i}" for i in range(900)]
    passage = " ".join(r.choice(words) for _ in range(60))
    texts = []
    for i in range(24):
        own = [r.choice(words) for _ in range(r.randint(60, 160))]
        texts.append(" ".join(own) + (f" {passage}" if i % 4 == 0 else ""))
    copy = texts[1].split()
    copy[5] = "changed"
    texts += [" ".join(copy), texts[2], "# $ % " * 40, "a b c " * 60, "short one", "", None, "line one\n" * 20 + texts[3]]
    rows = [(i, t, "en", None if t is None else len(t), "s", i, i, i) for i, t in enumerate(texts)] + [(0, texts[0], "en", len(texts[0]), "s", 0, 0, 0)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, source string, block long, n_removed long, node long")


def test_rules_by_hand(spark):
    from test_text_operators import rules_by_hand

    texts, docs = planted(spark)
    got = corpus_pipeline.ruled(spark, docs, "")
    assert got.dtypes == docs.dtypes

    def passes(t):
        n, chars, symbols, dup, repeats = rules_by_hand(t)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return n >= 50 and 100 * repeats <= 50 * n and 10 * symbols <= 3 * n and not (len(lines) >= 4 and 100 * dup > 50 * len(lines)) and 20 * n <= 10 * chars <= 200 * n

    assert sorted(r["doc_id"] for r in got.collect()) == sorted([i for i, t in enumerate(texts) if passes(t)] + [0] * passes(texts[0]))


def test_rules_take_nothing_from_a_sample(spark, monkeypatch):
    """No rows are drawn to count or time rules on; the dear one comes last, and the verdict is that of any order."""
    from tarmac.llm import quality_rules

    _, docs = planted(spark)
    want = sorted(r["doc_id"] for r in quality_rules.quality_rules(docs).where("kept").collect())
    asked, cascade = [], quality_rules.cascade
    for name in ("sample", "limit"):
        monkeypatch.setattr(type(docs), name, lambda *_, **__: pytest.fail("rows are drawn"))
    monkeypatch.setattr(quality_rules, "cascade", lambda rules, f: asked.append([r.name for r in rules]) or cascade(rules, f))
    got = corpus_pipeline.ruled(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert all(x[0] == "few_words" and x[-1] == "repeats" and len(x) == 6 for x in asked) and asked


def test_near_dedup_by_hand(spark):
    from test_corpus_operators import minhash_by_hand

    texts, docs = planted(spark)
    got = corpus_pipeline.deduplicated(spark, docs, "")
    assert got.dtypes == docs.dtypes
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for _, c in minhash_by_hand(texts, 80)})


def test_substrings_by_hand(spark):
    import hashlib

    from test_corpus_operators import repeats_by_hand

    texts, docs = planted(spark)
    docs = docs.where("doc_id > 0 or block > 0")
    got = corpus_pipeline.without_repeats(spark, docs, "").collect()
    want = dict(zip(range(1, len(texts)), repeats_by_hand(texts[1:]), strict=True))
    assert len(got) == len(want) and any(removed for _, removed, _ in want.values())
    for r in got:
        n, removed, digest = want[r["doc_id"]]
        assert hashlib.sha256(" ".join(r["text"].split()).encode()).hexdigest() == digest
        assert removed or r["text"] == (texts[r["doc_id"]] or "")
        assert r["n_chars"] == len(r["text"]) and r["block"] == r["n_removed"] == r["node"] == r["doc_id"]


def test_empty_documents(spark):
    _, docs = planted(spark)
    empty = docs.where("1 = 0")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, "").count() == 0, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_classifier_stage(spark):
    """The stage keeps what the operator marks as kept, whole rows of it, and not texts without words."""
    from tarmac.llm import kneser_ney

    texts, docs = planted(spark)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = corpus_pipeline.classified(spark, docs, DATA)
    want = kneser_ney.classify(docs, labels, ["doc_id"]).where("kept").select("doc_id").collect()
    rows = got.collect()
    assert got.dtypes == docs.dtypes and sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in want)
    assert all(r["text"] == texts[r["doc_id"]] and r["text"] for r in rows)
