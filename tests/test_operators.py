"""Operators on small tables, against plain Python where there is something to compute."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tarmac.operators import cache, catalog, decision, detect, hierarchy, maintenance, store, tfidf
from tarmac.sources import files, xlsx
from tarmac.streaming import ingest, progress

EVIDENCE = "e0 string, e1_valid boolean, e1 string, e2 string, e2_score double, e1_source string"


def test_decide(spark):
    cases = [
        (("21-26", True, "21-26", "21-26", 0.9, "AMM"), "CONFIRM", 0.97),
        (("32-41", True, "21-26", "21-26", 0.9, "AMM"), "CORRECT", 0.95),
        ((None, True, "21-26", "21-26", 0.9, "AMM"), "CORRECT", 0.95),
        (("21-26", False, None, "21-26", 0.9, None), "CONFIRM", 0.86),
        (("21-26", True, "21-26", None, None, "AMM"), "CONFIRM", 0.92),
        (("21-26", True, "32-41", "21-26", 0.5, "TSM"), "REVIEW", 0.85),
        (("21-26", True, "32-41", "21-26", 0.9, "TSM"), "REVIEW", 0.8075),
        (("21-26", False, None, None, None, None), "REVIEW", 0.5),
        ((None, False, None, None, None, None), "REVIEW", 0.55),
    ]
    rows = decision.decide_table(spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, " + EVIDENCE)).orderBy("i").collect()
    assert [(r["decision"], round(r["confidence"], 4)) for r in rows] == [c[1:] for c in cases]
    stats = {(r["kind"], r["name"]): r["n"] for r in decision.decision_stats(spark.createDataFrame(rows)).collect()}
    assert stats["all", "all"] == len(cases) and stats["decision", "REVIEW"] == 4


def test_candidates_and_arbitration(spark):
    df = spark.createDataFrame([("a", "21-26", "32-41", [("21-26", 0.7), ("33-10", 0.6)]), ("b", None, None, None)], "row_id string, e0 string, e1 string, e2s array<struct<ata04:string,score:double>>")
    c = df.select("row_id", decision.candidates(F.col("e0"), F.col("e1"), F.col("e2s")).alias("candidates"))
    assert [x["code"] for x in c.where("row_id = 'a'").head()["candidates"]] == ["32-41", "21-26", "33-10"]
    assert {r["row_id"]: r["choice"] for r in decision.arbitrate(c).collect()} == {"a": "32-41", "b": None}


def test_tfidf(spark):
    texts = {"a": "pump leak pump", "b": "leak at valve", "c": "valve valve open"}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    counts = tfidf.term_counts(df, "id", "text")
    v = tfidf.fit(counts, 3)
    got = {(r["id"], r["term"]): r["w"] for r in tfidf.weigh(counts, "id", v).collect()}
    grams = {k: Counter(w := t.split()) + Counter(" ".join(p) for p in zip(w, w[1:], strict=False)) for k, t in texts.items()}
    df_ = Counter(g for c in grams.values() for g in c)
    for k, c in grams.items():
        raw = {g: n * (math.log(4 / (1 + df_[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        for g, x in raw.items():
            assert abs(got[k, g] - x / norm) < 1e-12


def test_catalog(spark, tmp_path):
    rows = [(str(i), "21-26", "air pump leak found") for i in range(3)] + [(str(i + 3), "32-41", "brake wear noted here") for i in range(3)]
    memory = spark.createDataFrame(rows, "hash string, ata04 string, text string")
    c = catalog.build(memory, spark.createDataFrame([("21-26", "AIR")], "ATA04 string, Title string"))
    q = spark.createDataFrame([("q1", "pump leak", ""), ("q2", "brake", None), ("q3", "", "")], "q string, d string, a string")
    got = {r["q"]: r["ata04"] for r in catalog.match(c, q, "q", "d", "a", 1).collect()}
    assert got == {"q1": "21-26", "q2": "32-41"}
    catalog.save(c, str(tmp_path / "cat"))
    assert catalog.load(spark, str(tmp_path / "cat")).entries.count() == 2
    again = catalog.from_json(catalog.to_json(c.entries))
    assert {r["ata04"] for r in again.collect()} == {"21-26", "32-41"}
    assert [r["ATA04"] for r in catalog.flatten_json(catalog.to_json(c.entries)).collect()] == ["21-26", "32-41"]


def test_hierarchy(spark):
    lines = spark.createDataFrame([(0, "79 - ENGINE OIL"), (1, "79-32 - (IAE) - PUMP"), (2, "79-32-10 - DRIVE SHAFT UNIT X"), (3, "bad")], "seq long, text string")
    got = hierarchy.code_titles(hierarchy.nodes(lines)).collect()
    assert [(r["ATA04"], r["Title"]) for r in got] == [("79-32", "ENGINE OIL - PUMP [Includes: DRIVE SHAFT UNIT]")]
    fan = hierarchy.engine_fanout(spark.createDataFrame([("79-32",), ("21-26",)], "ata4 string")).collect()
    assert sorted((r["ata4"], r["engine_type"] or "") for r in fan) == [("21-26", ""), ("79-32", "IAE"), ("79-32", "PW11")]


def test_store(spark, tmp_path):
    path = str(tmp_path / "memory")
    df = spark.createDataFrame([("LEAK AT PUMP", "REPLACED", None, "2126"), ("LEAK AT PUMP", "REPLACED", "", "2126"), ("", "", None, "2126"), ("X Y", None, "32-41", "00")], "d string, a string, f string, e string")
    fresh = store.training_rows(df, "d", "a", "f", "e")
    assert store.append_training(spark, fresh, path, "one") == 2
    assert store.append_training(spark, fresh, path, "two") == 0
    assert store.compact(spark, path) == 0
    a = spark.createDataFrame([("21-26", "OLD"), ("32-41", "B")], "ATA04 string, Title string")
    b = spark.createDataFrame([("21-26", "NEW")], "ATA04 string, Title string")
    assert {tuple(r) for r in store.upsert_latest(a, b, ["ATA04"], "Title").collect()} == {("21-26", "NEW"), ("32-41", "B")}
    store.append_map(spark, a, str(tmp_path / "map"))
    store.append_map(spark, b, str(tmp_path / "map"))
    assert spark.read.parquet(str(tmp_path / "map")).count() == 2


def test_cache(spark):
    c = spark.createDataFrame([("a", "1", 100, 10, "m", 1), ("b", "2", 100, 0, "m", 2)], cache.SCHEMA)
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r["key"]: r["value"] for r in cache.lookup(c, keys, 200).collect()} == {"a": None, "b": "2", "c": None}
    assert cache.put(c, spark.createDataFrame([("a", "3", 150, 0, "m", 1)], cache.SCHEMA)).where("key = 'a'").head()["value"] == "3"
    assert cache.migrated(spark.createDataFrame([("a", "{bad", 1, 0, "m", 1), ("b", '{"x":1}', 1, 0, "m", 1)], cache.SCHEMA)).count() == 1


def test_detect_and_xlsx(spark, tmp_path):
    path = str(tmp_path / "wo.xlsx")
    df = spark.createDataFrame([("21-26", "LEAK & <x>", "FIXED"), ("32-41", None, "OK")], "`ATA` string, `W/O Description` string, `W/O Action` string")
    xlsx.write(df, path)
    back = xlsx.read(spark, path)
    assert back.columns == df.columns and {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    assert detect.kind_of(back) == "WO"
    assert set(detect.NEEDED) <= set(detect.internal(back).columns)
    assert detect.kind_of(spark.createDataFrame([("21-26", "AIR")], "Code string, Name string")) == "ATA_MAP"
    assert detect.kind_of(spark.createDataFrame([("x",)], "a string")) == "unknown"
    rec = files.unstructured(xlsx.read_cells(spark, path)).collect()
    assert {r["ata4"] for r in rec} == {"21-26", "32-41"}
    assert files.listing(spark, str(tmp_path)).count() == 1


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "memory")
    schema = "d string, a string, e string"
    spark.createDataFrame([("LEAK", "FIXED", "2126"), ("LEAK", "FIXED", "2126")], schema).write.parquet(src)
    for _ in range(2):
        ingest.ingest_stream(ingest.watch(spark, src, schema), out, str(tmp_path / "cp"), "d", "a", None, "e").awaitTermination()
    assert spark.read.parquet(out).count() == 1
    seen = []
    assert list(progress.tracked([1, 2], 2, lambda p: seen.append(p.percent))) == [1, 2] and seen == [50.0, 100.0]


def test_maintenance(spark, tmp_path):
    table = str(tmp_path / "map")
    store.append_map(spark, spark.createDataFrame([("21-26", "A")], store.MAP), table)
    assert maintenance.backup(spark, {"map": table, "none": str(tmp_path / "none")}, str(tmp_path / "b")) == ["map"]
    store.append_map(spark, spark.createDataFrame([("32-41", "B")], store.MAP), table)
    assert maintenance.rollback(spark, str(tmp_path / "b")) == ["map"] and spark.read.parquet(table).count() == 1
    assert maintenance.integrity(spark.read.parquet(table), {"ATA04", "x"}).head()["missing"] == "x"
    cases = spark.createDataFrame([("AMM 21-26-40", "21-26"), ("CMM 21-26-40", None), ("none", "21-26")], "text string, expected string")
    assert tuple(maintenance.citation_tally(cases).head()) == (2, 1)


def test_enrich(spark, tmp_path):
    path = str(tmp_path / "map.xlsx")
    xlsx.write(spark.createDataFrame([("79 - OIL",), ("79-32 - PUMP",)], "Code string"), path, "ATA")
    code_map = files.code_map(spark, path)
    assert [tuple(r) for r in code_map.collect()] == [("79-32", "OIL - PUMP")]
    records = spark.createDataFrame([(None, "79-32", None, "PUMP", "oil pump", 1), (None, None, "79-32-10", "SHAFT", "", 2)], "ata2 string, ata4 string, ata6 string, title string, description string, seq long")
    items = maintenance.enrich(records, code_map, spark.createDataFrame([("79-32", "leak seen")], "ata4 string, text string"))
    got = items.collect()
    assert sorted(r["engine_type"] for r in got) == ["IAE", "PW11"] and {r["name"] for r in got} == {"OIL - PUMP"} and "leak" in got[0]["keywords"]
    assert '"count":2' in hierarchy.enriched_json(items).head()["value"]


def test_swap_lock_and_order(spark, tmp_path):
    """A crash between two renames loses no table; a lock keeps a second writer out; the last title stands."""
    import os

    import pytest

    path = str(tmp_path / "map")
    store.append_map(spark, spark.createDataFrame([("21-26", "Z"), ("21-26", "B")], store.MAP), path)
    assert [r["Title"] for r in spark.read.parquet(path).collect()] == ["B"]
    os.rename(path, f"{path}.new-x")
    assert store.read_or_empty(spark, path, store.MAP).count() == 1 and os.path.isdir(path)
    with store.locked(spark, path):
        with pytest.raises(TimeoutError), store.locked(spark, path, 0.3):
            pass
    assert not os.path.exists(f"{path}.lock")
    titles = store.last_titles(spark.createDataFrame([("21-26", "Z"), ("21-26", "A"), ("32-41", "B")], store.MAP).coalesce(1))
    assert {tuple(r) for r in titles.collect()} == {("21-26", "A"), ("32-41", "B")}


def test_cache_upkeep(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [("a", "1", 100, 10, "m", 1), ("b", "2", 100, 0, "m", 2), ("b", "3", 120, 0, "m", 2)]
    spark.createDataFrame(rows, cache.SCHEMA).write.parquet(path)
    assert cache.cleanup(spark, path, 200) == 1 and cache.vacuum(spark, path) == 1
    assert [r["value"] for r in spark.read.parquet(path).collect()] == ["3"]
    assert cache.clear(spark, path) == 1 and spark.read.parquet(path).count() == 0


def test_workbooks_by_their_own_headers(spark, tmp_path):
    one, two = spark.createDataFrame([("x", "y")], "a string, b string"), spark.createDataFrame([("p", "q", "r")], "b string, a string, c string")
    xlsx.write(one, str(tmp_path / "1.xlsx"))
    xlsx.write(two, str(tmp_path / "2.xlsx"))
    got = xlsx.read(spark, str(tmp_path / "*.xlsx"))
    assert got.columns == ["a", "b", "c"] and {tuple(r) for r in got.collect()} == {("x", "y", None), ("q", "p", "r")}


def test_dates_of_workbooks(spark):
    cases = ["45809", "45809.5", "2025-06-01", "x", None, "0"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, d string").select("i", detect.read_date(F.col("d")).cast("string").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == ["2025-06-01 00:00:00", "2025-06-01 12:00:00", "2025-06-01 00:00:00", None, None, None]


def test_class_starts(spark):
    """The start of all documents joined, whatever stands behind it."""
    docs = [("a", i % 3, "text number %d of the class" % i) for i in range(50)] + [("b", 0, None), ("b", 1, "x")]
    got = {r["k"]: r["t"] for r in hierarchy.class_starts(spark.createDataFrame(docs, "k string, o int, t string"), "k", "t", "o", 120).collect()}
    whole = "\n\n".join(t for _, t in sorted((o, t) for k, o, t in docs if k == "a"))
    assert got == {"a": whole[:120], "b": "\n\nx"}
