"""Hard inputs: clashing names, repeated ids, hostile tables, large groups, planted costs, and what the methods decide."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import components, html_text, kneser_ney, licenses, media, minhash_dedup, quality_rules, substring_dedup, tokens, url_filters
from tarmac.llm.blocks import hashed, runs, word_hashes, words_in
from tarmac.llm.common import Workspace

#: Names that the operators use inside.
NAMES = ["block", "z", "row", "limit", "own", "kept", "perplexity", "n_symbols", "n_removed", "node", "label", "one", "h", "key", "text2", "odd name"]


def named(spark, texts, first="lang"):
    rows = [(i, t, "en", *range(len(NAMES))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` long" for n in NAMES))


def test_clashing_names(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["the", "house", "was", "old", "and", "green"]) + str(r.randrange(9)) for _ in range(80)) for _ in range(30)] + [None, ""]
    d = named(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    same = {tuple(x) for x in d.where("text <> ''").select("doc_id", *[f"`{n}`" for n in NAMES]).collect()}
    good = kneser_ney.keep_good(d, labels)
    assert good.columns == d.columns and good.dtypes == d.dtypes and {tuple(x) for x in good.select("doc_id", *[f"`{n}`" for n in NAMES]).collect()} <= same
    scored = kneser_ney.classify(d, labels, ["doc_id", "lang", "block", "kept", "limit"])
    assert scored.columns == ["doc_id", "lang", "block", "n_symbols", "perplexity", "limit", "kept"] and dict(scored.dtypes)["kept"] == "boolean"
    clean = substring_dedup.without_repeats(d)
    assert clean.columns == d.columns and clean.dtypes == d.dtypes and clean.count() == d.count()
    one = minhash_dedup.keep_one(d)
    assert one.columns == d.columns and one.dtypes == d.dtypes
    assert quality_rules.keep_passing(d).dtypes == d.dtypes


def test_repeated_ids_with_other_texts(spark):
    """Rows of one id with a text, another text and none; a near copy is linked with the first."""
    text = " ".join(map(str, range(100)))
    d = spark.createDataFrame([(0, text), (0, None), (0, "another text of some words here"), (1, text + " end"), (2, "another text of some words here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(d).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (0, 96, 0), (1, 97, 0), (2, 2, 0)]


def test_one_large_bucket(spark, monkeypatch):
    """Thousands of different near copies of one text, in chains: linked without a bucket in one task, a pair of all, or a cap."""
    monkeypatch.setattr(minhash_dedup, "CELL_BLOCK", 512)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(3000):
        words = list(base)
        words[3 + i % 3] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(5000 + i, " ".join(f"y{j}" for j in range(i, i + 120))) for i in range(60)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component_id").count().collect()
    # a sliding window over 120 words moves by one: 115 of 117 shingles stay
    assert {r["component_id"]: r["count"] for r in got} == {0: 3000, 5000: 60}


def test_links_through_refuted_pairs(spark):
    """Candidates that full sets refute don't hide links between other members of their buckets."""
    r = random.Random(9)
    texts = []
    for _ in range(6):
        base = [f"b{r.randrange(10**9)}" for _ in range(100)]
        for k in range(12):
            words = list(base)
            for _ in range(3 * (k % 4)):
                words[r.randrange(100)] = f"n{r.randrange(10**9)}"
            texts.append(" ".join(words))
    from test_corpus_operators import minhash_by_hand

    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == minhash_by_hand(texts)


def test_words_and_hashes():
    """Words as bytes.split has them; equal words have equal hashes whatever stands around, others differ."""
    r = random.Random(2)
    texts = [bytes(r.choice(b" \t\n\x0b\x0c\rabc\x1c\x85\xc3\xa9") for _ in range(r.randrange(60))) for _ in range(400)] + [b"", b" ", b"x" * 100, b"x" * 32, b"x" * 33]
    words, sizes = words_in(texts)
    flat = [w for t in texts for w in t.split()]
    assert [w.as_buffer().to_pybytes() for w in words] == flat and sizes.tolist() == [len(t.split()) for t in texts]
    h = word_hashes(words)
    by_word = dict(zip(flat, h.tolist(), strict=True))
    assert [by_word[w] for w in flat] == h.tolist() and len(set(by_word.values())) == len(by_word)
    for t in texts[:50]:
        assert hashed([t])[0].tolist() == [by_word[w] for w in t.split()]


def passages_case():
    r = random.Random(4)
    base = [f"v{i}".encode() for i in range(300)]
    texts = []
    for i in range(80):
        a = r.randrange(250)
        x = base[a : a + r.randint(20, 90)]
        if i % 3 == 0:
            x.insert(r.randrange(len(x)), b"odd%d" % i)
        if i % 7 == 0:
            x = [b"p", b"q"] * r.randint(10, 60)
        texts.append(b" ".join(x))
    return texts


def known_windows(texts, w):
    from collections import Counter

    block = substring_dedup.Block(runs(texts))
    keys, _, fits = block.windows(w)
    count = Counter(keys[fits].tolist())
    return block, keys, fits, np.array(sorted(k for k, c in count.items() if c > 1), "u8")


@pytest.mark.parametrize("hits", [7, 250_000])
def test_automaton_decides(monkeypatch, hits):
    """Its hits are the occurrences: equal to those by window keys, and gone without it."""
    monkeypatch.setattr(substring_dedup, "_HITS", hits)
    texts = passages_case()
    block, keys, fits, known = known_windows(texts, 35)
    found = substring_dedup.Passages(block.passages(known, 35), 35).windows(block.words)
    want = np.zeros(len(block.words), bool)
    want[: len(keys)] = fits & np.isin(keys, known)
    assert (found == want).all() and want.any()
    _, gone = substring_dedup.occurrences(runs(texts), known, 35)
    assert gone.any()
    monkeypatch.setattr(substring_dedup.Passages, "windows", lambda self, words: np.zeros(len(words), bool))
    _, gone = substring_dedup.occurrences(runs(texts), known, 35)
    assert not gone.any()


def test_passages_are_compared_word_for_word():
    """A text that shares a passage's stretch but not a whole window isn't an occurrence, even if its key were known."""
    words = [f"a{i}".encode() for i in range(60)]
    other = [b"x%d" % i for i in range(20)] + words[18:36] + [b"y%d" % i for i in range(20)]
    texts = [b" ".join(words), b" ".join(words), b" ".join(other)]
    _, _, _, known = known_windows(texts, 35)
    _, gone = substring_dedup.occurrences(runs(texts), known, 35)
    assert gone[:60].all() and gone[61:121].all() and not gone[122:].any()


def test_hostile_media():
    """Counts beyond the file are errors, not memory; fragments and compact sizes are read."""
    b, f = media._box, media._full

    def table(kind, *rows):
        return f(kind, struct.pack(">I", len(rows)), *[struct.pack(f">{len(r)}I", *r) for r in rows])

    def movie(stbl, extra=b"", number=1):
        mdia = b(b"mdia", f(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 0, 0, 0)), f(b"hdlr", bytes(4), b"vide", bytes(13)), b(b"minf", b(b"stbl", *stbl)))
        tkhd = f(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0), bytes(60))
        return b(b"moov", b(b"trak", tkhd, mdia), extra)

    stsd = f(b"stsd", struct.pack(">I", 1), b(b"avc1", bytes(78)))
    huge = movie((stsd, table(b"stss", (1,)), table(b"stsc", (1, 2**32 - 1, 1)), f(b"stsz", struct.pack(">II", 1, 2**32 - 1)), table(b"stco", (8,))))
    assert media.describe(huge) == ([], "more samples than the file can hold")
    empty = (stsd, table(b"stts"), table(b"stsc"), f(b"stsz", struct.pack(">II", 0, 0)), table(b"stco"))
    head = movie(empty, b(b"mvex", f(b"trex", struct.pack(">5I", 1, 1, 10, 4, 0x10000))))

    def fragment(data_at):
        run = f(b"trun", struct.pack(">IiI", 3, data_at, 0) + struct.pack(">3I", 5, 6, 7), flags=0x205)
        return b(b"moof", f(b"mfhd", struct.pack(">I", 1)), b(b"traf", f(b"tfhd", struct.pack(">I", 1), flags=0x20000), run))

    moof = fragment(len(fragment(0)) + 8)
    data = head + moof + b(b"mdat", b"AAAAABBBBBBCCCCCCC")
    (t,) = media.read_tracks(data)
    assert media.read_payload(data, t) == b"AAAAABBBBBBCCCCCCC" and t.n_samples == 3 and t.duration == 30
    start = len(head + moof) + 8
    assert t.keyframes.tolist() == [[start, start + 5]]
    bad = b(b"moof", b(b"traf", f(b"tfhd", struct.pack(">I", 1)), f(b"trun", struct.pack(">I", 2**31))))
    assert media.describe(head + bad)[1] and media.describe(bad)[1]
    for bits, sizes in ((4, bytes([0x57, 0x90])), (8, bytes([5, 7, 9])), (16, struct.pack(">3H", 5, 7, 9))):
        (t,) = media.read_tracks(b(b"mdat", bytes(60)) + movie((stsd, table(b"stts", (3, 10)), table(b"stsc", (1, 3, 1)), f(b"stz2", struct.pack(">II", bits, 3), sizes), table(b"stco", (8,)))))
        assert t.ranges.tolist() == [[8, 29]] and t.n_samples == 3


def test_cascade_follows_costs(spark):
    """Dear rules come after cheap ones that reject as much; among equals in cost the one that rejects more comes first."""
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) + (" rare" if i % 50 == 0 else "") + (" often" if i % 2 else "") for i in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def dear(f):
        loops = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.lit(0), lambda a, i: a + F.length(F.sha2(F.concat(f.text, i.cast("string")), 512)))
        return (loops > 0) & f.text.endswith(" often")

    rules = [
        quality_rules.Rule("dear", dear),
        quality_rules.Rule("never", lambda f: f.text.endswith(" never")),
        quality_rules.Rule("rare", lambda f: f.text.contains(" rare")),
        quality_rules.Rule("cheap", lambda f: f.text.endswith(" often")),
    ]
    from tarmac.llm.common import Workspace

    plan = quality_rules.plan_cascade(d, rules, Workspace(spark, "test"))
    order = [r.name for r, _, _ in plan]
    assert order[-1] == "never" and order.index("cheap") < order.index("dear")
    shares = {r.name: share for r, _, share in plan}
    assert shares == {"dear": 0.5, "cheap": 0.5, "rare": 0.02, "never": 0.0}
    assert [r.name for r, _, _ in quality_rules.plan_cascade(d.where("1=0"), rules, Workspace(spark, "test"))] == [r.name for r in rules]
    got = quality_rules.quality_rules(d).where("not base_failed and rejected_by is not null and kept").count()
    assert got == 0


@pytest.mark.parametrize("form", [quality_rules.Packed, quality_rules.Paired])
def test_repeated_windows_with_equal_hashes(spark, form, monkeypatch):
    """Windows are told apart by their words even if all their hashes are equal."""
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    r = random.Random(3)
    texts = [" ".join(r.choice("ab cd ef gh".split()) for _ in range(r.randint(3, 40))) for _ in range(20)]
    d = spark.createDataFrame([(t.split(),) for t in texts], "w array<string>")
    got = [x["n"] for x in d.select(quality_rules._repeated_words(F.col("w"), 3, form()).alias("n")).collect()]
    from test_text_operators import rules_by_hand

    assert got == [rules_by_hand(t)[4] for t in texts]


def test_each_word_encoded_once(spark, monkeypatch):
    """Buckets see every distinct word of all blocks once; pieces that aren't the word come back as they decode."""
    path = tokens.default_path()
    texts = [f"a common line of words {i % 3} <|endoftext|> \x00 é �" for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = tokens.load(path)
    for r in tokens.encode(d, block_bytes=200).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)
    known = tokens.WordIds(path)
    assert known.learn(["a", "b", "a"]) == ["a", "b"] and known.learn(["b", "c"]) == ["c"]


def test_url_components_against_sql(spark):
    import duckdb
    import pandas as pd

    r = random.Random(8)
    hosts = ["a.net/es", "b.org/x", "www.example.com/en", "d.example.com/en", "z.com/q", "e.net/fr"] + [f"h{i}.org/p" for i in range(30)]
    urls = [f"http://{r.choice(hosts)}/{i}{r.choice(['', '?a=1&b=2', '#f'])}" for i in range(120)]
    rows = []
    for i, u in enumerate(urls):
        target = r.choice(urls)
        href = r.choice([target, target.replace("&", "&amp;"), target[5:], "/es/1"])
        html = r.choice(["", f'<link rel="canonical" href="{href}">', f"<meta http-equiv=refresh content='0; url={target}'>", f'<LINK href="{href}" rel=canonical><p>x'])
        rows.append((i, u, html))
    rows += [(200, None, "x"), (201, "nothing", '<link rel=canonical href="http://a.net/es/9">'), (202, urls[0], None)]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = sorted(map(repr, con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_filters.ORACLE_SQL})").fetchall()))
    got = url_filters.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, map(tuple, got))) == want
    assert sum(x["verdict"] == "block" and x["rule"] is None for x in got) > 3


PAGES = {
    '<div class="layout has-sidebar"><article>The story</article></div>': "The story",
    '<article class="post comments-open">The story</article>': "The story",
    '<div class="content no-sidebar"><article>The story</article></div>': "The story",
    '<article><p title="a <b> c">The story</p></article>': "The story",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_pages_that_lost_their_article(page):
    assert html_text.Page(page).text() == PAGES[page]


def test_deep_pages_take_linear_time():
    import time

    spent = []
    for n in (4000, 16000):
        began = time.perf_counter()
        html_text.Page("<div>" * n + "x" + "</div>" * n).bodies()
        spent.append(time.perf_counter() - began)
    assert spent[1] < 12 * max(spent[0], 0.02)


def brute_templates(pages):
    """host, text of an element -> different rest texts, by string work alone, for pages of flat elements."""
    import re
    from collections import defaultdict

    beside = defaultdict(set)
    for host, parts in pages:
        for p in parts:
            beside[host, p].add(" ".join(re.sub("<[^>]*>", " ", "".join(q for q in parts if q != p)).split()))
    return {k for k, v in beside.items() if len(v) >= html_text.MIN_DISTINCT}


def test_templates_against_brute_force(spark):
    """Blocks inside the article that recur beside five different texts of a host go, on that host only."""
    import re

    r = random.Random(12)
    boxes = [f"<div><b>Box {k}</b> read on</div>" for k in range(4)]
    pages, rows = [], []
    for i in range(60):
        host = f"h{i % 3}.org"
        parts = [f"<p>Story number {i} of the day</p>", f"<p>More of story {i}</p>"] + [x for k, x in enumerate(boxes) if r.random() < (0.9, 0.5, 0.1, 0.02)[k]]
        r.shuffle(parts)
        pages.append((host, parts))
        rows.append((i, f"http://{host}/{i}", f"<html><body><article>{''.join(parts)}</article></body></html>"))
    gone = brute_templates(pages)
    assert gone
    got = {x["page_id"]: x["text"] for x in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (host, parts) in enumerate(pages):
        kept = [p for p in parts if (host, p) not in gone]
        assert got[i] == " ".join(" ".join(re.sub("<[^>]*>", " ", p).split()) for p in kept)
    assert any((host, p) in gone for host, parts in pages for p in parts)


def test_every_license_family_and_passage():
    """Each name of each family, phrased, gives its label; versions theirs; and every passage is found as it stands."""
    for label, names, versions in licenses.FAMILIES:
        for name in names:
            assert label in licenses.scan(f"This file is licensed under the {name}.")[5].split(","), name
            for v in versions:
                assert f"{label}-{v.replace(' ', '.')}" in licenses.scan(f"released under {name} version {v.replace(' ', '.')}")[5].split(","), (name, v)
    for kind, *names in licenses.CC_KINDS:
        assert any(x.startswith(f"cc-{kind}") for x in licenses.scan(f"This work is under CC {names[-1].upper()} 4.0")[5].split(",")), kind
    plain = [(label, regex) for label, regex, _, _ in licenses.PASSAGES if not any(c in regex for c in "(?\\[")]
    assert len(plain) > 8
    for label, regex in plain:
        assert label in licenses.scan(f"Note: {regex}, as stated.")[5].split(","), regex


def test_licenses_without_the_prefilter():
    """Every rule on every text, suppressed by comparing all pairs, finds what the gated rules find."""
    import re

    r = random.Random(6)
    names = [n for _, ns, _ in licenses.FAMILIES for n in ns]
    bits = ["licensed under the", "released under", "version 2.0", "v 3", "SPDX-License-Identifier:", "and", "all rights reserved", "CC BY-SA 4.0", "public domain", "in the public domain", "use only", "dual licensed under"]
    rules = [(re.compile(rb" (?:" + s.regex.encode() + rb")(?= )"), s) for s in licenses.signatures()]
    for _ in range(25):
        norm = licenses.words_of(" ".join(r.choice(bits if r.random() < 0.6 else names) for _ in range(r.randint(1, 14))))
        found = sorted(((m.start(), m.end(), s) for p, s in rules for m in p.finditer(norm)), key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        kept: list = []
        for a, b, s in found:
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, s))
        assert licenses.detect(norm) == kept


@pytest.mark.parametrize("block", [8192, 48])
def test_tables_grow_with_members(spark, monkeypatch, block):
    """Texts that share most of a template and are no links, with a few links between them: no table holds their pairs."""
    from test_corpus_operators import minhash_by_hand

    monkeypatch.setattr(minhash_dedup, "CELL_BLOCK", block)
    r = random.Random(12)
    template = [f"t{i}" for i in range(200)]
    texts = [" ".join(template + [f"n{r.randrange(10**9)}" for _ in range(28)]) for _ in range(300)]
    for i in range(10):
        words = texts[i].split()
        words[210:212] = f"m{i}", f"k{i}"
        texts.append(" ".join(words[: 220 + i % 9]))
    sizes = {}
    write = minhash_dedup.Workspace.write

    def counted(self, df, name="t"):
        out = write(self, df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(minhash_dedup.Workspace, "write", counted)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = minhash_by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want and 250 < len({c for _, c in want}) < len(texts)
    # a row for each band at most, and for each pair of chunks that a bucket has
    assert max(sizes.values()) <= minhash_dedup.BANDS * len(texts) * -(-len(texts) // block), sizes


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, most):
    """A shuffled path, a hub, random edges, loops, repeats and null ends, with ids of any size: the same by both ways."""
    from test_corpus_operators import components_by_hand

    monkeypatch.setattr(components, "TASK_EDGES", most)
    r = random.Random(4)
    names = sorted(r.randrange(-(1 << 62), 1 << 62) for _ in range(900))
    path = r.sample(range(300), 300)
    pairs = [*zip(path, path[1:]), *[(599, i) for i in range(300, 599)], *[(r.randrange(600, 900), r.randrange(600, 900)) for _ in range(160)], (5, 5), (700, 700)]
    rows = [(names[a], names[b]) for a, b in pairs]
    ws = Workspace(spark, "test")
    edges = ws.write(spark.createDataFrame(rows + rows[:50] + [(b, a) for a, b in rows[300:350]] + [(None, names[0]), (names[0], None)], "u long, v long").repartition(7))
    got = [tuple(x) for x in components.components(ws, edges).collect()]
    hand = components_by_hand(900, pairs)
    assert sorted(got) == sorted((names[i], names[hand[i]]) for i in {x for a, b in pairs for x in (a, b) if a != b})
    assert components.components(ws, edges.where("u = v")).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_near_duplicates_write_few_tables(spark, monkeypatch, most):
    """Chains of near copies: where all links fit one task, their components take no rounds of tables."""
    from test_corpus_operators import minhash_by_hand

    monkeypatch.setattr(components, "TASK_EDGES", most, raising=False)
    r = random.Random(13)
    texts = []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(150)]
        for _ in range(25):
            words[r.randrange(150)] = f"x{r.randrange(10**9)}"
            texts.append(" ".join(words))
    r.shuffle(texts)
    written, write = [], minhash_dedup.Workspace.write
    monkeypatch.setattr(minhash_dedup.Workspace, "write", lambda self, df, name="t": written.append(name) or write(self, df, name))
    rows = minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = minhash_by_hand(texts)
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows) == [(i, *x) for i, x in enumerate(want)]
    assert max(np.unique([c for _, c in want], return_counts=True)[1]) > 10
    assert not most or len(written) <= 20, written
