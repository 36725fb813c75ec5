"""Text, code and citation functions on small tables of cases."""

from pyspark.sql import functions as F

from tarmac.functions import citations, codes, defect, text
from tarmac.operators import detect


def values(spark, cases, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", column(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_manual_references(spark):
    got = values(spark, ["AMM 21 51 00", "TSM21-51-00-400-001", "FIM  21  51", "see amm 29-11-00 now", None, "no"], text.manual_references)
    assert got == ["AMM 21-51-00", "TSM 21-51-00-400-001", "FIM 21-51", "see AMM 29-11-00 now", "", "no"]


def test_clean(spark):
    got = values(spark, ["ECAM FAULT\n09:24 SIGNED\nPUMP  WORN", None, " \n", "BY VAE03251", "LEAK AT 09:24"], text.clean)
    assert got == ["ECAM-FAULT PUMP WORN", "", "", "", "LEAK AT 09:24"]
    assert values(spark, got, text.clean) == got


def test_split_and_similarity(spark):
    got = values(spark, ["A LEAK | ACTION: FIXED", "X RECTIFICATION: Y", "PLAIN", None], text.split_defect_action)
    assert [tuple(r) for r in got] == [("A LEAK", "FIXED"), ("X", "Y"), ("PLAIN", ""), ("", "")]
    assert values(spark, ["pump leak", "", "pump"], lambda c: text.similarity(c, F.lit("PUMP LEAK"))) == [1.0, 0.0, 0.5]


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁx",), ("abc",), (None,)], "x string")
    assert sorted(r["x"] or "" for r in text.nfkc(df, "x").collect()) == ["", "abc", "fix"]


def test_codes(spark):
    assert values(spark, ["21-26", "ATA 3241", "7", None, "rev 1 of 21-26"], codes.ata04) == ["21-26", "32-41", None, None, "12-12"]
    assert values(spark, ["21-26", "00-00", "99-99", "x 21-26"], lambda c: codes.ata04(c, strict=True)) == ["21-26", None, None, None]
    assert values(spark, ["21-26-40-001", "292600", "32-41-00-01", "21"], codes.sequence) == ["21-26-40-001", "29-26-00", "32-41-00-01", "21"]
    assert values(spark, ["21-26-40-001"], lambda c: codes.sequence(c, compat=True)) == ["21-26-400-01"]
    assert [tuple(r) if r else None for r in values(spark, ["79-32-15 - PUMP", "79 - ENGINE", "nothing"], codes.parse_level)] == [("79-32-15", "PUMP", 6), ("79", "ENGINE", 2), None]
    assert values(spark, ["2126", "21-26-40", "x", None], codes.catalog_code) == ["21-26", "21-26", None, None]


def test_citations(spark):
    cases = ["REF AMM 21-26-40-001", "TSM 36-11-00 AND AMM 29-11-00", "CMM 32-41-00", "TASK 21-26-40-001", "REF 292600", "20250609", None]
    best = values(spark, cases, citations.best)
    assert [(b["manual"], b["ata04"]) if b else None for b in best] == [("AMM", "21-26"), ("TSM", "36-11"), None, ("UNKNOWN", "21-26"), ("UNKNOWN", "29-26"), None, None]
    assert values(spark, ["CMM 32-41-00"], lambda c: citations.best(c, compat=True))[0]["manual"] == "UNKNOWN"
    assert len(values(spark, ["AMM 21-26-40 AMM 21-26-40"], citations.extract)[0]) == 1


def test_defects(spark):
    rows = [
        (0, "HYD PUMP LEAK", "REPLACED", None),
        (1, "ROUTINE CHECK", "NO FINDING", "SCHEDULED"),
        (2, "ECAM FAULT", "CHECK SATIS", "SCHEDULED"),
        (3, None, None, None),
        (4, "ROUTINE INSPECTION", "", "ROUTINE"),
        (5, "ODD", "THING", None),
    ]
    df = spark.createDataFrame(rows, "i int, d string, a string, t string")
    got = {r["i"]: (r["is_technical"], r["rule"]) for r in defect.classify(df, "d", "a", "t").collect()}
    assert got[0] == (True, "strong_symptom") and got[1] == (False, "scheduled_no_finding") and got[2] == (False, "symptom_but_no_finding")
    assert got[3] == (False, "empty") and got[4][0] is False and got[5] == (True, "safety_first")
    assert defect.classify(df, "d", "a", "t", compat=True).where("i = 3").head()["is_technical"] is True
    k = {r["i"]: (r["is_technical_defect"], r["confidence"]) for r in defect.classify_keywords(df, "d", "a", "t").collect()}
    assert k[0] == (True, 0.9) and k[1] == (False, 0.9) and k[5] == (False, 0.6)


def test_whole_keyword_patterns(spark):
    """Patterns keep their own word ends: SB 12A counts as a bulletin, TRANSACTION isn't an action column."""
    rows = [(0, "SB 12A EMBODIED", "", "UNSCHEDULED"), (1, "AD 2020X", "", "UNSCHEDULED"), (2, "SERVICEABLES", "", "UNSCHEDULED")]
    got = {r["i"]: r["reason"] for r in defect.classify_keywords(spark.createDataFrame(rows, "i int, d string, a string, t string"), "d", "a", "t").collect()}
    assert got == {0: "routine", 1: "routine", 2: "no keyword"}
    assert detect.find_column(["TRANSACTION", "W/O Action"], detect.COLUMNS["action"]) == "W/O Action"
    assert detect.find_column(["DATA 04"], detect.COLUMNS["entered"]) is None


def test_decomposed_text_is_normalized(spark):
    import unicodedata

    rows = [(0, unicodedata.normalize("NFD", "phát hiện rò rỉ"), None, None), (1, "phát hiện rò rỉ", None, None)]
    got = {r["i"]: r["rule"] for r in defect.classify(spark.createDataFrame(rows, "i int, d string, a string, t string"), "d", "a", "t").collect()}
    assert got == {0: "strong_symptom", 1: "strong_symptom"}


def test_bare_patterns_answer_alike(spark):
    """A test without what stands free around the words gives the same answer as the whole pattern."""
    from tarmac.functions import lexicons

    cases = ["NOTE: SEE", "x refer note 3", "BY VAE03251 AND MORE", "AT 09:24", "1 WORKSTEP9 A", "FINDING (NRC) X", "plain", "", "see notes", "S.O-A321-1 z"]
    for patterns in (lexicons.META_LINES, lexicons.CLEAN_META):
        whole = values(spark, cases, lambda c, p=patterns: c.rlike(lexicons.any_of(p)))
        assert values(spark, cases, lambda c, p=patterns: c.rlike(lexicons.bare(p))) == whole


def test_on_distinct(spark):
    """Repeated and missing values get the same result, each distinct row is made once."""
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "b"), (4, "", "b")], "i int, x string, y string")
    out = text.on_distinct(df, ["x", "y"], lambda d: d.withColumn("n", F.concat_ws("/", F.coalesce("x", F.lit("-")), F.coalesce("y", F.lit("-")))))
    assert out.columns == ["i", "x", "y", "n"] and {r["i"]: r["n"] for r in out.collect()} == {1: "a/-", 2: "a/-", 3: "-/b", 4: "/b"}
