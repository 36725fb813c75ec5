"""Operators that compare documents with each other or with a model, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import kneser_ney, minhash_dedup, substring_dedup
from tarmac.llm.blocks import deal
from tarmac.llm.common import Workspace
from tarmac.llm.components import connected_components

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components_by_hand(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(shape)
    n = 60
    pairs = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(40)], "none": []}[shape]
    edges = spark.createDataFrame(pairs + pairs[:3], "u long, v long")
    got = {x["node"]: x["component"] for x in connected_components(Workspace(spark, "test"), edges).collect()}
    hand = components_by_hand(n, pairs)
    assert got == {i: hand[i] for i in {x for p in pairs for x in p if p[0] != p[1]}}


def minhash_by_hand(texts, percent=85):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append(({tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [(len(s), c) for s, c in zip(sets, components_by_hand(len(sets), pairs), strict=True)]


@pytest.mark.parametrize("block", [192, 16])
def test_minhash(spark, block, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "CELL_BLOCK", block)
    r = random.Random(2)
    texts = [" ".join(map(str, range(140)))]
    for _ in range(150):
        x = r.choice(texts).split()
        for _ in range(r.choice([1, 1, 2, 3])):
            x[r.randrange(len(x))] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(x))
    texts += ["", "a b", "A B", None, " \n", "a b c d e", texts[0].upper()]
    d = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, cls long")
    extra = spark.createDataFrame([(None, texts[0], 1), (0, texts[0], 1)], "doc_id long, text string, cls long")
    rows = minhash_dedup.near_duplicates(d.union(extra)).collect()
    assert len(rows) == len(texts) + 2
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows if x["doc_id"] is not None}
    assert [got[i] for i in range(len(texts))] == minhash_by_hand(texts)
    assert all(x["kept"] == (x["doc_id"] is not None and x["doc_id"] == x["component_id"]) for x in rows)
    kept = minhash_dedup.keep_one(d.union(extra), 85)
    assert kept.columns == d.columns and kept.count() == len({c for _, c in minhash_by_hand(texts)}) + 1
    assert minhash_dedup.near_duplicates(d.where("1=0")).count() == 0


def repeats_by_hand(texts, w=35):
    words = [[x.encode() for x in WORDS.findall(t or "")] for t in texts]
    count = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for x in words:
        gone = {j for i in range(len(x) - w + 1) if count[tuple(x[i : i + w])] > 1 for j in range(i, i + w)}
        out.append((len(x), len(gone), hashlib.sha256(b" ".join(a for i, a in enumerate(x) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("blocks", [1, 7])
def test_substrings(spark, blocks):
    r = random.Random(1)
    base = [str(i) for i in range(400)]
    texts = []
    for i in range(90):
        a = r.randint(0, 300)
        x = base[a : a + r.randint(20, 120)]
        if r.random() < 0.3:
            x = ["a"] * r.randint(1, 90)
        if r.random() < 0.2:
            x = (["p", "q", "r"] * 40)[: r.randint(30, 100)]
        if r.random() < 0.5:
            x.insert(r.randint(0, len(x)), f"X{i}")
        texts.append(" ".join(x) + r.choice(["", "\n", " \t", "é", "\xa0z"]))
    texts += [None, "", texts[0], texts[0]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dealt = deal(d, ["doc_id"], blocks)
    windows = substring_dedup.recurring_windows(Workspace(spark, "test"), dealt)
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    got = {x[0]: tuple(x[1:]) for x in substring_dedup.locate(dealt, windows, substring_dedup._digest, schema, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_by_hand(texts)
    clean = substring_dedup.remove_repeats(d.withColumn("block", F.lit("x")).union(spark.createDataFrame([(None, "lost", "x")], "doc_id long, text string, block string")).withColumnRenamed("block", "source"), ["doc_id", "source"])
    assert clean.count() == len(texts) + 1
    assert substring_dedup.remove_repeats(d.where("1=0"), ["doc_id"]).count() == 0


def kneser_ney_by_hand(train, order):
    """log probability of a symbol after its context, from dictionaries."""
    counts = {order: Counter()}
    for t in train:
        s = [kneser_ney.BEGIN] * (order - 1) + [min(ord(c), kneser_ney.SYMBOLS - 1) for c in t]
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: kneser_ney.discounts(*[sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]) for n in counts}
    total, mass = {n: Counter() for n in counts}, {n: defaultdict(float) for n in counts}
    for n, c in counts.items():
        for g, x in c.items():
            total[n][g[:-1]] += x
            mass[n][g[:-1]] += d[n][min(x, 3) - 1]

    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else 1 / kneser_ney.SYMBOLS
        if not total[n][g[:-1]]:
            return low
        x = counts[n][g]
        return ((x - d[n][min(x, 3) - 1]) if x else 0) / total[n][g[:-1]] + mass[n][g[:-1]] / total[n][g[:-1]] * low

    return p


def test_kneser_ney(spark):
    r = random.Random(3)
    train = ["".join(r.choice("aab bc ") for _ in range(40)) for _ in range(12)] + [""]
    texts = ["abba", "zz top", "", None, "a", "abc " * 30, "äß漢"]
    ws = Workspace(spark, "test")
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"), ws)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["perplexity"] for x in kneser_ney.perplexities(d, model, ws, ["doc_id"]).collect()}
    p = kneser_ney_by_hand(train, kneser_ney.ORDER)
    for i, t in enumerate(texts):
        if not t:
            assert got[i] is None
            continue
        s = [kneser_ney.BEGIN] * 4 + [min(ord(c), kneser_ney.SYMBOLS - 1) for c in t]
        want = math.exp(-sum(math.log(p(tuple(s[k : k + 5]))) for k in range(len(t))) / len(t))
        assert abs(got[i] - want) < 1e-4 * want


def test_classifier(spark):
    r = random.Random(5)
    good = [(i, " ".join(r.choice(["the", "house", "was", "old", "and", "green"]) for _ in range(40)), "en") for i in range(80)]
    junk = [(100 + i, "".join(r.choice("#$%&*!?XQZ") for _ in range(200)), "en") for i in range(10)]
    other = [(200, None, "en"), (201, "", None), (202, "the house was green and old", None), (None, "the old house", "en"), (203, "the house", "xx")]
    d = spark.createDataFrame(good + junk + other + good[:1], "doc_id long, text string, lang string").withColumn("limit", F.lit(1)).withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(100, 0, 0), (0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["kept"] for x in kneser_ney.classify(d.drop("limit"), labels, ["doc_id", "lang"]).collect()}
    assert not any(got[100 + i] for i in range(10)) and sum(got[i] for i in range(80)) >= 76
    assert got[200] is False and got[201] is False and got[202] is True
    kept = kneser_ney.keep_good(d.select("doc_id", "text", "lang", "source"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source"] and kept.where("doc_id between 100 and 109").count() == 0
    none = kneser_ney.classify(d.drop("limit"), labels.where("1=0"), ["doc_id", "lang"])
    assert none.where("kept").count() == d.where("text <> ''").count()
    assert kneser_ney.classify(d.drop("limit").where("1=0"), labels, ["doc_id", "lang"]).count() == 0


def test_classifier_limits(spark, monkeypatch):
    """A language with few unseen trusted documents takes the common limit; one outlier sets none; poor ones choose."""
    monkeypatch.setattr(kneser_ney, "TRAIN_DOCS", 60)
    r = random.Random(6)
    words = ["the", "house", "was", "old", "and", "green"]
    good = [(i, " ".join(r.choice(words) for _ in range(60)), "en") for i in range(400)]
    unseen = spark.range(500, 600).where("pmod(xxhash64(id, 11), 1000) >= 800").head()[0]
    outlier = [(unseen, "qzx jvk " * 30, "de")]
    poor = [(600 + i, " ".join(r.choice([*words, "hsuoe", "eth"]) for _ in range(60)), "en") for i in range(40)]
    junk = [(700 + i, "".join(r.choice("qzxjvk") for _ in range(200)), "de") for i in range(5)]
    labels = [(i, 1, 0) for i, _, _ in good + outlier] + [(i, 0, 0) for i, _, _ in poor]
    d = spark.createDataFrame(good + outlier + poor + junk, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["kept"] for x in kneser_ney.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ["doc_id", "lang"]).collect()}
    assert sum(got[i] for i, _, _ in good) >= 370
    assert not any(got[i] for i, _, _ in poor + junk)


def test_every_trusted_document_counts(spark, monkeypatch):
    """Of more trusted documents than the former bound each one is trained on or sets the limits."""
    r = random.Random(8)
    words = ["the", "house", "was", "old", "and", "green"]
    d = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(20)), "en") for i in range(2300)], "doc_id long, text string, lang string")
    labels = spark.range(2200).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    trained, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda docs, ws: trained.extend(x["doc_id"] for x in docs.collect()) or train(docs, ws))
    rows = kneser_ney.classify(d, labels, ["doc_id"]).collect()
    split = {x["id"] for x in spark.range(2200).where(f"pmod(xxhash64(id, 11), 1000) < {int(1000 * kneser_ney.TRAIN_SHARE)}").collect()}
    assert sorted(trained) == sorted(split) and len(split) > 1600
    held = sorted(x["perplexity"] for x in rows if x["doc_id"] < 2200 and x["doc_id"] not in split)
    limits = [held[math.ceil(q * len(held)) - 1] * m for m in kneser_ney.MARGINS for q in kneser_ney.QUANTILES]
    (limit,) = {x["limit"] for x in rows}
    assert any(abs(limit - x) < 1e-9 * x for x in limits)


def test_limits_are_exact_quantiles(spark):
    """Of more values than a sketch holds, repeated and in any order, each quantile is the value of that very rank."""
    r = random.Random(9)
    rows = [(r.choice(["en", "en", "en", "de", "", None]), r.choice([None, 7.0, *[r.lognormvariate(1.5, 0.3)] * 8])) for _ in range(150_000)]
    d = spark.createDataFrame(rows, "lang string, perplexity double").repartition(16)
    shares = kneser_ney.QUANTILES
    got = {(x["whole"], x["lang"]): (x["n"], x["q"]) for x in kneser_ney.order_statistics(d, shares, Workspace(spark, "test")).collect()}
    own = {(False, k): sorted(p for lang, p in rows if lang == k and p is not None) for k in ("en", "de", "")}
    own[True, ""] = sorted(p for _, p in rows if p is not None)
    assert got == {k: (len(v), [v[math.ceil(s * len(v)) - 1] for s in shares]) for k, v in own.items()}
    # What the limits were before: values near the rank.
    near = d.agg(F.percentile_approx("perplexity", F.array(*map(F.lit, shares)), 10000).alias("q")).head()["q"]
    assert near != got[True, ""][1]
    assert kneser_ney.order_statistics(d.where("perplexity is null"), shares, Workspace(spark, "test")).count() == 0


def test_symbols_of_other_scripts():
    """Characters from U+0FFF on tell texts apart, and don't become Latin letters."""
    texts = ["\u4e2d\u6587\u5b57\u7b26", "\u5b57\u6587\u7b26\u4e2d", "\u3053\u308c\u306f\u4f55", "\ud55c\uad6d\uc5b4\ub97c", "\u201c\u2014\u2019\ufffd", "\U0001f600\U0001f601\U0001f602\U0001f603"]
    keys, sizes = kneser_ney.gram_keys([t.encode() for t in texts])
    assert sizes.tolist() == [4] * 6 and len(set(keys.tolist())) == len(keys)
    last = keys & np.uint64(kneser_ney.SYMBOLS - 1)
    assert len(set(last[:4].tolist())) == 4 and (last >= kneser_ney.FOLD).all()
