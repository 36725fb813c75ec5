"""Operators that treat each document on its own, against brute force, with nulls, blanks, repeats and odd names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarmac.llm import html_text, licenses, media, packing, quality_rules, tokens, url_filters

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    None, "", " \n\t", "One two three.", "a b c a b c a b c\na b c\na b c", "Es ist gut, ja.\n\nÜber\xa0alles  hin.", "x" * 5000, "ered*** reed*** <|endoftext|> It's 42.",
    "Licensed under the Apache License, Version 2.0.", "cc by CC-BY cc by", "word " * 3000, "\x1c \x85 é é 　 中文 ½", "One two three.", "All rights reserved.\n" * 3, "it's we'll don't 'tis",
]


def docs(spark, extra=""):
    """Rows with repeated ids, a null id and columns whose names operators also use."""
    rows = [(i, t, "en", "s", 0, 1, 2, 3) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None, None, None, None), (None, "lost id", "en", None, 0, 0, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, block long, kept long")


def by_text(df, column="doc_id"):
    return {r[column]: r for r in df.collect()}


def test_media(spark):
    d = docs(spark)
    got = media.payload_features(media.store_texts(d)).collect()
    assert len(got) == d.count()
    for r in got:
        if r["doc_id"] is not None:
            raw = (TEXTS[r["doc_id"]] or "").encode()
            payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert media.media_columns(media.store_texts(d.where("1=0"))).count() == 0


def test_media_tables():
    for n in (64, 4096, 4097, 20000):
        payload = bytes(random.Random(n).randbytes(n))
        for wide in (False, True):
            data = media.write_samples(payload, wide=wide)
            (t,) = media.read_tracks(data)
            assert media.read_payload(data, t) == payload and (t.codec, t.n_samples, t.duration) == ("raw ", n, n)
            for cut in range(0, len(data) - n, 37):
                media.describe(data[:cut])
            assert media.describe(data[:-1])[1]
    # keyframes of samples of different sizes in two chunks
    b, f = media._box, media._full
    import struct

    def table(kind, *rows):
        return f(kind, struct.pack(">I", len(rows)), *[struct.pack(f">{len(r)}I", *r) for r in rows])

    stbl = b(b"stbl", f(b"stsd", struct.pack(">I", 1), b(b"avc1", bytes(78))), table(b"stts", (3, 10)), table(b"stss", (1,), (3,)), table(b"stsc", (1, 2, 1), (2, 1, 1)), f(b"stsz", struct.pack(">II3I", 0, 3, 5, 7, 9)), table(b"stco", (8,), (40,)))
    mdia = b(b"mdia", f(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 30, 0, 0)), f(b"hdlr", bytes(4), b"vide", bytes(13)), b(b"minf", stbl))
    (t,) = media.read_tracks(b(b"mdat", bytes(60)) + b(b"moov", b(b"trak", mdia)))
    assert t.keyframes.tolist() == [[8, 13], [40, 49]] and t.ranges.tolist() == [[8, 20], [40, 49]] and t.codec == "avc1"


def test_licenses(spark):
    got = licenses.scan_licenses(docs(spark)).collect()
    for r in got:
        if r["doc_id"] is not None:
            w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (TEXTS[r["doc_id"]] or "").translate(LOWER))
            hits = [i for p, _ in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), min(hits, default=None), max(hits, default=None))
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert 200 < len(licenses.signatures()) and licenses.scan(TEXTS[8])[5] == "apache-2.0"
    assert licenses.scan("under the GNU General Public License version 3 and the MIT License")[5] == "gpl,gpl-3,mit"


def test_suppression_against_all_pairs():
    r = random.Random(4)
    for _ in range(300):
        found = [(a := r.randrange(30), a + r.randrange(1, 12), licenses.Signature("l", "", "", r.randrange(3), 1.0)) for _ in range(12)]
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0]))
        kept = []
        for a, b, s in found:
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, s))
        assert licenses._unsuppressed(found) == kept


def test_packing(spark):
    d = docs(spark)
    rows = packing.packed(d, with_ids=True).collect()
    t = packing.words_for(packing.default_path()).t
    by_doc: dict = {}
    by_seq: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for k, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        at: Counter = Counter()
        for r in by_doc[k]:
            assert r["ids"] == ids[r["start"] : r["start"] + r["length"]] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["doc_tokens"] == len(ids)
            at.update(range(r["start"], r["start"] + r["length"]))
        assert at == Counter(dict.fromkeys(range(len(ids)), 2 if k == 3 else 1))
    for seq in by_seq.values():
        n = sum(r["length"] for r in seq)
        assert n == 2048 or n & (n - 1) == 0
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    assert packing.packed(d.where("1=0")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_first_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = sorted((r.choice([1, 7, r.randint(1, 300), r.randint(1, 9000)]) for _ in range(r.randint(0, 60))), reverse=True)
    seen: Counter = Counter()
    for seq in packing.pack(lengths):
        n = sum(p[2] for p in seq)
        assert n == 2048 or packing.power_of_two(n)
        seen.update((k, i) for k, a, n in seq for i in range(a, a + n))
    assert seen == Counter((k, i) for k, n in enumerate(lengths) for i in range(n))
    bins = packing.Tournament(len(lengths) or 1, 2048)
    room = [2048] * len(lengths)
    for n in (x for x in lengths if x <= 2048):
        first = next(i for i, x in enumerate(room) if x >= n)
        room[first] -= n
        assert bins.take(n) == first


def test_bpe(spark):
    d = docs(spark)
    t = tokens.load(tokens.default_path())
    got = tokens.encode(d, block_bytes=4000).collect()
    assert len(got) == d.count()
    for r in got:
        if r["doc_id"] is not None:
            ids = t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["ids"] == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(d.where("doc_id is not null"))).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(TEXTS))
    assert tokens.encode(d.where("1=0")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_split_words_random(seed):
    r = random.Random(seed)
    t, known = tokens.load(tokens.default_path()), tokens.WordIds(tokens.default_path())
    pw = packing.words_for(packing.default_path())
    parts = ["a", "b ", "  ", "\n", " \n", "'s", " ", "\t", "é", "1", "...", "<|endoftext|>", " ", "x.", "\n\n", "\0", "　", "½", "中", "\x85", "\x1c", "İ", "ſ", "́", ". ", ",", "_", "The", "K", "***"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        words = tokens.split_words(text)
        known.learn(words)
        assert "".join(words) == text
        assert np.frombuffer(b"".join(known[w] for w in words), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        words = packing._split(text)
        assert np.frombuffer(b"".join(pw[w] for w in words), "<u2").tolist() == pw.t.encode(text, add_special_tokens=False).ids


def test_words_cut_by_place():
    """White space in one place of a text leaves the other places cut, and texts in a row are cut as each alone."""
    assert tokens.split_words("one.two\tthree, four  .five\n\nsix\nx") == ["one", ".two\tthree", ",", " four", "  .five", "\n\nsix", "\n", "x"]
    parts = ["a", "b ", "  ", "\n", " \n", "\r\n", "'ll", "\t", "é", "ñ.", "×", "÷,", "²,", "1.5", "...", "<|endoftext|>", "<|.|>", "\xa0.", "\u180e", "\u2003", "\u2028", "\u200b", "\u3000.", "\x85", "\x1c", "\0", "\u0301.", "中.", "_.", "x.", "😀,", "“", "."]
    r = random.Random(4)
    t, known = tokens.load(tokens.default_path()), tokens.WordIds(tokens.default_path())
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    words, sizes = tokens.cut_words([x.encode() for x in texts])
    words = [w.decode() for w in words.to_pylist()]
    known.learn(words)
    ends = np.cumsum([0, *sizes]).tolist()
    for text, a, b in zip(texts, ends, ends[1:], strict=False):
        assert words[a:b] == tokens.split_words(text) and "".join(words[a:b]) == text
        assert np.frombuffer(b"".join(known[w] for w in words[a:b]), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(words) == ends[-1]


def test_bpe_join_makes_no_object_for_each_word():
    """A block's words, ids and bytes are joined as arrays: few Python bytes for each byte of text, and the same digests."""
    import tracemalloc

    import pyarrow as pa
    import zstandard

    class Step:
        """Stands for a table, and holds the function that a task would run."""

        def __getattr__(self, name):
            return lambda *a: setattr(self, "run", a[0]) or self if name.endswith("InArrow") else self

    texts = [None, " ".join(f"{'abcdefg'[i * i % 7]}{i % 997}" for i in range(150_000)), "", "<|endoftext|> é.\0"]
    z = [zstandard.ZstdCompressor().compress((x or "").encode()) for x in texts]
    left = pa.table({"block": pa.array([0] * 4, pa.int32()), "doc_id": pa.array([3, None, 3, 4], pa.int64()), "z": pa.array(z, pa.binary())})
    path = tokens.default_path()
    words = tokens.distinct_words(Step(), 4).run(left)
    right = pa.Table.from_batches(tokens.encode_words(Step(), 4, path).run(words.combine_chunks().to_batches()))
    join = tokens.join_by_position(Step(), Step(), 4, tokens._digest, tokens._DIGEST, "").run
    tracemalloc.start()
    got = join(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * sum(len(x or "") for x in texts)
    t = tokens.load(path)
    for x, n, ids, decoded in zip(texts, *(got.column(c).to_pylist() for c in ("n_tokens", "ids_sha256", "decoded_sha256")), strict=True):
        own = t.encode(x or "", add_special_tokens=False).ids
        assert n == len(own) and ids == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert decoded == hashlib.sha256(t.decode(own, skip_special_tokens=False).encode()).hexdigest()
    assert got.column("doc_id").to_pylist() == [3, None, 3, 4]
    long = [z[0], zstandard.ZstdCompressor().compress(b"a b" * 1_500_000), z[0]]
    runs = pa.table({"block": pa.array([0] * 3, pa.int32()), "doc_id": pa.array([1, 2, 3], pa.int64()), "z": pa.array(long, pa.binary())})
    words = tokens.distinct_words(Step(), 4).run(runs)
    own = pa.Table.from_batches(tokens.encode_words(Step(), 4, path).run(words.combine_chunks().to_batches()))
    assert join(runs, own).column("n_tokens").to_pylist() == [0, len(t.encode("a b" * 1_500_000, add_special_tokens=False).ids), 0]
    empty = pa.table({"block": pa.array([0], pa.int32()), "doc_id": pa.array([9], pa.int64()), "z": pa.array(z[:1], pa.binary())})
    assert tokens.distinct_words(Step(), 4).run(empty).num_rows == 0 and join(empty, right.slice(0, 0)).column("n_tokens").to_pylist() == [0]


def rules_by_hand(text):
    t = text or ""
    w = WORDS.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    d = docs(spark)
    r = random.Random(1)
    more = [" ".join(r.choice("ab cd ef gh ij".split()) for _ in range(r.randint(0, 120))) for _ in range(60)]
    both = d.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = quality_rules.quality_rules(both).collect()
    assert len(got) == both.count()
    for x in got:
        if x["doc_id"] is not None:
            text = TEXTS[x["doc_id"]] if x["doc_id"] < 1000 else more[x["doc_id"] - 1000]
            hand = rules_by_hand(text)
            assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == hand
            assert x["base_failed"] == (hand[0] < 50 or 100 * hand[4] > 50 * hand[0]) and not (x["base_failed"] and x["kept"])
    assert quality_rules.keep_passing(d).columns == d.columns
    assert quality_rules.quality_rules(d.where("1=0")).count() == 0


PAGE = '<html><head><title>T</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one <b>two</b><br>three<p>four</article><div class="comments">reader</div><footer>foot'


def test_html(spark):
    shared = '<div class="teaser"><p>read this too</p></div>'
    rows = [(1, "http://a.b/1", PAGE), (2, None, None), (3, "http://a.b/2", ""), (4, "x", "plain &lt; text")] + [(10 + i, "http://h.c/x", f"<body>{shared}<section><p>story number {i}</p></section></body>") for i in range(6)]
    d = spark.createDataFrame([(*r, "clash") for r in rows + rows[:1]], "page_id long, url string, html string, text string")
    got = html_text.main_texts(d).collect()
    assert len(got) == len(rows) + 1
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == "A & B one two three four" and texts[2] == texts[3] == "" and texts[4] == "plain < text"
    assert [texts[10 + i] for i in range(6)] == [f"story number {i}" for i in range(6)]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and html_text.main_texts(d.where("1=0")).count() == 0


def test_html_templates_inside_the_article(spark):
    box = '<div class="box"><h2>More</h2>Read <a href="/x">this</a></div>'
    rows = [(i, f"http://h.c/{i}", f"<body><article><h1>Title {i}</h1>{box}<p>Story {i}<p>Follow us<ul><li>item {i}<li>Print</ul></article></body>") for i in range(6)]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Title {i} Story {i} item {i}" for i in range(6)}


def test_html_copies_and_large_hosts(spark):
    copy = '<body><div class="content"><p>The whole text</p></div></body>'
    rare = '<div class="box">In this section</div>'
    rows = [(i, f"http://c.c/{i}", copy) for i in range(8)] + [(100 + i, "http://h.c/x", f"<body>{rare if i < 6 else ''}<div>Story {i}</div></body>") for i in range(80)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == ["The whole text"] * 8
    assert [got[100 + i] for i in range(80)] == [f"Story {i}" for i in range(80)]


@pytest.mark.parametrize("start", ["div class='layout with-sidebar'", "div class=content-sidebar-wrap", "div class=no-banner", "div class=social-news", "form action=x", "div id=sidebar", "aside"])
def test_html_marked_elements_around_the_article(start):
    end = start.split()[0]
    assert html_text.Page(f"<body><{start}><nav>menu</nav><article>The story <div class='share-box'>f</div></article><div class=comments-area>reader</div></{end}></body>").text() == "The story"
    if start != "aside":
        assert html_text.Page(f"<body><{start}><nav><a>menu</a></nav><div>The story</div></{end}></body>").text() == "The story"
    assert html_text.Page("<body><article>The story</article><div class=sidebar><article>A much longer teaser of another one</article></div></body>").text().startswith("The story")
    assert html_text.Page("<div class='ad x'>A long advert</div><div class=sidebar>no</div><p>The story").text() == "The story"


def test_urls(spark):
    rows = [
        (1, "https://www.Example.com/en/1", None), (2, "http://x.example.com/en/2", ""), (3, "http://a.net/es/?q", "<p>"), (4, None, None), (5, "nothing", ""), (6, "http://x.org/a#f", '<link rel="canonical" href="http://a.net/fr/z">'),
        (7, "http://y.org/b", '<meta http-equiv="refresh" content="0; url=http://x.org/a">'), (8, "http://z.com/c", '<link href="http://y.org/b" rel="canonical">'), (9, "http://com", ""), (10, "http://w.org/q", '<link rel=canonical href="/r">'),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in rows + rows[:1]], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_filter(d).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[2] == ("x.example.com", "/en/2", "example.com/en/", "block")
    assert got[3] == ("a.net", "/es/", "net/es/", "block") and got[4] == got[5] == ("", "", None, "allow") and got[9] == ("com", "", None, "allow")
    # an alias is allowed by a rule, so the class isn't blocked
    assert got[6][3] == got[7][3] == got[8][3] == "allow" and got[8][2] == "com/"
    got = {r["page_id"]: (r["verdict"], r["by"]) for r in url_filters.url_filter(d.where("page_id <> 8")).collect()}
    assert got[6] == got[7] == ("block", "alias") and got[10] == ("allow", "default")
    assert url_filters.url_filter(d.where("1=0")).count() == 0


def test_relative_links(spark):
    """Targets as urllib resolves them, with references decoded; blocks reach such aliases."""
    from urllib.parse import urljoin

    refs = ["page2.html", "../x", "?id=1", "./y?a=1&amp;b=2", "/p/./q/../r", "//k.org/z", "http://x.org/?a=1&#38;b=&#x32;", "..", "a/b/", "/r?u=http://z.org/", "/a&ltb"]
    plain = [r.replace("&amp;", "&").replace("&#38;", "&").replace("&#x32;", "2") for r in refs]
    for base in ("", "/b/c/d", "sub/"):
        rows = [(f"http://h.org/one/two/{i}", (f'<base href="{base}">' if base else "") + f'<link rel="canonical" href="{r}">') for i, r in enumerate(refs)]
        got = {r["url"]: r["target"] for r in url_filters.page_edges(spark.createDataFrame(rows, "url string, html string")).collect()}
        assert got == {u: urljoin(urljoin(u, base), p) for (u, _), p in zip(rows, plain, strict=True)}
    d = spark.createDataFrame([(1, "http://a.net/es/1?a=1&b=2", '<link rel=canonical href="../../s?x&amp;y">'), (2, "http://b.org/q", '<meta http-equiv=refresh content="0; url=http://a.net/s?x&#38;y">')], "page_id long, url string, html string")
    assert {r["page_id"]: (r["verdict"], r["by"]) for r in url_filters.url_filter(d).collect()} == {1: ("block", "rule"), 2: ("block", "alias")}
