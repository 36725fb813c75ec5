"""Registered queries of the engine and the same in DuckDB's SQL.

WO stands for the work-order view in the SQL texts. Tokens and lines are ASCII there, so that both engines' regular
expressions agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, codes, defect, text
from ..operators import cache, catalog, decision, hierarchy, store, tfidf
from .workorders import SQL, work_orders

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = f"WITH wo AS ({SQL}) {oracle.strip()}" if " wo" in oracle else oracle.strip()
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def judged(d: DataFrame) -> DataFrame:
    """technical, e1 and e1_source of distinct (defect, action, wo_type)."""
    j = defect.classified(d, "defect", "action", "wo_type").withColumnRenamed("is_technical", "technical")
    named = F.col("technical") | citations.hinted(F.col("defect"), F.col("action"))
    j = j.withColumn("c", F.when(named, citations.best(F.concat_ws("\n", "defect", "action"))))
    return j.select(*d.columns, "technical", F.col("c.ata04").alias("e1"), F.col("c.manual").alias("e1_source"))


def matched(j: DataFrame, c: catalog.Catalog | None) -> DataFrame:
    """j with e2 and e2_score: the best class for the texts of technical rows; other rows have none."""
    if c is None:
        return j.withColumns({"e2": F.lit(None).cast("string"), "e2_score": F.lit(None).cast("double")})
    both = F.concat_ws("\x1f", F.coalesce("defect", F.lit("\0")), F.coalesce("action", F.lit("\0")))
    keyed = j.withColumn("q", F.when(F.col("technical"), F.sha2(both, 256))).persist()
    texts = keyed.where("q is not null").select("q", "defect", "action").dropDuplicates(["q"])
    best = catalog.match(c, texts, "q", "defect", "action", 1).select("q", F.col("ata04").alias("e2"), F.col("score").alias("e2_score"))
    return keyed.join(best, "q", "left").drop("q")


def evidence(wo: DataFrame, c: catalog.Catalog | None = None) -> DataFrame:
    """wo with technical, e0, e1, e1_source, e1_valid, e2, e2_score. Distinct texts are judged and matched once."""
    e = text.on_distinct(wo, ["defect", "action", "wo_type"], lambda d: matched(judged(d), c))
    valid = F.coalesce(decision.citation_valid(F.col("technical"), F.col("e1")), F.lit(False))
    return e.select(*wo.columns, "technical", codes.ata04(F.col("entered")).alias("e0"), "e1", "e1_source", valid.alias("e1_valid"), "e2", "e2_score")


def decided(wo: DataFrame, c: catalog.Catalog | None = None) -> DataFrame:
    """Verdicts from the entered code, the citation and, if there is a catalog, its best class for technical rows."""
    return decision.decide_table(evidence(wo, c))


def cited_catalog(wo: DataFrame) -> catalog.Catalog:
    """A catalog of the cited codes, from the distinct texts of the work orders that cite one."""
    texts = citations.with_citations(wo.select("defect", "action").distinct(), "defect", "action")
    cited = F.get(F.filter("citations", lambda x: x["ata04"].isNotNull()), F.lit(0))["ata04"]
    rows = texts.select(text.pair_hash(F.col("defect"), F.col("action")).alias("hash"), cited.alias("ata04"), text.compose(F.col("defect"), F.col("action")).alias("text"))
    none = wo.sparkSession.createDataFrame([], "ATA04 string, Title string")
    return catalog.build(rows.where("ata04 is not null"), none)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the work orders."""
    wo = work_orders(spark, sf_dir)
    return decided(wo, cited_catalog(wo)).groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


# --- memory ---------------------------------------------------------------------------------------------------

_MEM = "mem AS (SELECT defect AS text, entered AS ata04, sha1(coalesce(defect, '')) AS hash, seq, wo_id FROM wo WHERE entered IS NOT NULL AND length(defect) > 0)"


def memory(spark, sf_dir) -> DataFrame:
    return work_orders(spark, sf_dir).where("entered is not null and length(defect) > 0").select(F.col("defect").alias("text"), F.col("entered").alias("ata04"), text.text_hash(F.col("defect")).alias("hash"), "seq", "wo_id")


@query(f", {_MEM} SELECT hash, ata04, text FROM (SELECT *, row_number() OVER (PARTITION BY hash, ata04 ORDER BY seq, wo_id) AS r FROM mem) WHERE r = 1 -- FROM wo")
def dedup_first(spark, sf_dir):
    return store.keep_first(memory(spark, sf_dir), ["hash", "ata04"], "seq", "wo_id").select("hash", "ata04", "text")


@query("SELECT entered AS ATA04, max_by(defect, (seq, wo_id)) AS Title FROM wo WHERE entered IS NOT NULL AND defect IS NOT NULL GROUP BY entered")
def dedup_latest_map(spark, sf_dir):
    rows = work_orders(spark, sf_dir).where("entered is not null and defect is not null").select(F.col("entered").alias("ATA04"), F.col("defect").alias("Title"), "seq", "wo_id")
    return store.upsert_latest(rows.where("1 = 0"), rows, ["ATA04"], "seq", "wo_id").select("ATA04", "Title")


@query(f", {_MEM} SELECT count(*) AS n_rows, count(DISTINCT ata04) AS n_classes, round(avg(length(text)), 2) AS avg_length FROM mem -- wo")
def training_stats(spark, sf_dir):
    return store.stats(memory(spark, sf_dir))


@query(f", {_MEM} SELECT ata04, count(*) AS docs FROM mem GROUP BY ata04 ORDER BY docs DESC, ata04 LIMIT 20 -- wo")
def top20_classes(spark, sf_dir):
    return store.class_counts(memory(spark, sf_dir), 20)


@query(f", {_MEM} SELECT sum(d)::BIGINT AS total, round(avg(d), 6) AS mean, min(d) AS least, max(d) AS most, count(*) FILTER (WHERE d < 10) AS below FROM (SELECT count(*) AS d FROM mem GROUP BY ata04) -- wo")
def class_summary(spark, sf_dir):
    return store.class_summary(memory(spark, sf_dir), 10).withColumn("mean", F.round("mean", 6))


@query(f", {_MEM} SELECT round(avg(CASE WHEN m.ata04 IN (SELECT lpad(CAST(21 + s_suppkey % 30 AS VARCHAR), 2, '0') || '-' || lpad(CAST(10 + s_suppkey % 80 AS VARCHAR), 2, '0') FROM supplier) THEN 1.0 ELSE 0.0 END) * 100, 2) AS coverage_percent FROM (SELECT DISTINCT ata04 FROM mem) m -- wo")
def label_coverage(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    code = F.concat(F.lpad((21 + F.col("s_suppkey") % 30).cast("string"), 2, "0"), F.lit("-"), F.lpad((10 + F.col("s_suppkey") % 80).cast("string"), 2, "0"))
    return store.coverage(memory(spark, sf_dir), s.select(code.alias("ATA04")))


@query(f", {_MEM}, k AS (SELECT sha1(text || '||' || ata04) AS hash, seq, ata04 FROM mem) SELECT DISTINCT hash FROM k WHERE seq % 2 = 1 AND hash NOT IN (SELECT hash FROM k WHERE seq % 2 = 0 AND ata04 < '60') -- wo")
def incremental_anti(spark, sf_dir):
    m = memory(spark, sf_dir).withColumn("hash", text.pair_hash(F.col("text"), F.col("ata04")))
    return store.new_rows(m.where("seq % 2 = 0 and ata04 < '60'"), m.where("seq % 2 = 1")).select("hash")


@query(f", {_MEM} SELECT hash, min(g) AS gen FROM (SELECT hash, 0 AS g FROM mem WHERE ata04 < '40' UNION ALL SELECT hash, 1 FROM mem WHERE ata04 >= '40') GROUP BY hash -- wo")
def merged_memory(spark, sf_dir):
    m = memory(spark, sf_dir)
    a, b = m.where("ata04 < '40'").withColumn("gen", F.lit(0)), m.where("ata04 >= '40'").withColumn("gen", F.lit(1))
    return store.merged(a.select("text", "ata04", "hash", "gen"), b.select("text", "ata04", "hash", "gen")).select("hash", "gen")


@query(f", {_MEM} SELECT ata04, least(count(*), 5) AS docs FROM mem GROUP BY ata04 -- wo")
def class_cap(spark, sf_dir):
    return store.capped(memory(spark, sf_dir), 5).groupBy("ata04").agg(F.count("*").alias("docs"))


_CACHE = "c AS (SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS key, props AS value, CAST(floor(epoch(ts)) AS BIGINT) AS ts, (event_id % 5) * 86400 AS ttl, event_type AS model, CAST(length(props) AS INTEGER) AS tokens, event_id FROM events), n AS (SELECT max(ts) AS now FROM c)"


def cache_table(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), F.unix_timestamp(F.col("ts")).alias("ts"), ((F.col("event_id") % 5) * 86400).alias("ttl"), F.col("event_type").alias("model"), F.length("props").alias("tokens"), "event_id")


def _now(df: DataFrame) -> int:
    return df.agg(F.max("ts")).head()[0] or 0


@query(f"WITH {_CACHE} SELECT event_id FROM c, n WHERE ttl > 0 AND now - ts > ttl")
def ttl_expired(spark, sf_dir):
    c = cache_table(spark, sf_dir)
    return c.where(cache.expired(_now(c))).select("event_id")


@query(f"WITH {_CACHE} SELECT count(*) AS total, count(*) FILTER (WHERE ttl > 0 AND now - ts > ttl) AS expired, count(*) FILTER (WHERE NOT (ttl > 0 AND now - ts > ttl)) AS active, round(sum(length(value)) / 1048576.0, 2) AS mb, sum(tokens)::BIGINT AS tokens FROM c, n")
def cache_stats(spark, sf_dir):
    c = cache_table(spark, sf_dir)
    return cache.stats(c, _now(c))


@query(f"WITH {_CACHE} SELECT model, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM c GROUP BY model")
def cache_stats_by_type(spark, sf_dir):
    return cache.by_model(cache_table(spark, sf_dir))


@query(f"WITH {_CACHE} SELECT key, max(ts) AS ts FROM c GROUP BY key")
def upsert_latest(spark, sf_dir):
    c = cache_table(spark, sf_dir).select("key", "value", "ts", "ttl", "model", "tokens")
    return cache.put(c.where("1 = 0"), c).select("key", "ts")


@query(f"WITH {_CACHE} SELECT k.key, max(c.ts) AS ts FROM (SELECT DISTINCT 'click-' || CAST(user_id AS VARCHAR) AS key FROM events) k LEFT JOIN (SELECT c.* FROM c, n WHERE NOT (ttl > 0 AND now - ts > ttl)) c ON c.key = k.key GROUP BY k.key")
def cache_lookup(spark, sf_dir):
    c = cache_table(spark, sf_dir)
    keys = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("click-"), F.col("user_id").cast("string")).alias("key")).distinct()
    return keys.join(cache.live(c, _now(c)), "key", "left").groupBy("key").agg(F.max("ts").alias("ts"))


# --- text and codes -------------------------------------------------------------------------------------------


@query(r"SELECT wo_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(action, ''), '\b(ECAM|EICAS|CAS|CFDS)\s+(FAULT|FAIL|WARN|CAUTION|ADVISORY)\b', '\1-\2', 'gi'), '\b(BITE|FWC)\s+(FAULT|FAIL|TEST)\b', '\1-\2', 'gi'), '\b(LRU|UNIT)\s+(FAIL|FAULT|INOP)\b', '\1-\2', 'gi')) AS out FROM wo")
def sysmsg_hyphen(spark, sf_dir):
    return work_orders(spark, sf_dir).select("wo_id", F.trim(text.system_messages(F.col("action"))).alias("out"))


@query(r"SELECT wo_id, regexp_replace(regexp_replace(regexp_replace(coalesce(action, ''), '\bTSM 36 11 00\b', 'TSM 36-11-00', 'g'), '\bFIM21-51\b', 'FIM 21-51', 'g'), '\b(AMM|TSM|FIM|IPC) +(\d)', '\1 \2', 'g') AS out FROM wo")
def manual_ref_norm(spark, sf_dir):
    return work_orders(spark, sf_dir).select("wo_id", text.manual_references(F.col("action")).alias("out"))


@query(r"""SELECT wo_id, trim(regexp_replace(array_to_string(list_filter(string_split(replace(coalesce(defect, ''), 'UNIT FAIL', 'UNIT-FAIL'), chr(10)), lambda x: trim(x) <> '' AND (regexp_matches(x, '(?i)\b(AMM|TSM|FIM|IPC|WDM|SRM|ECAM|EICAS|CAS|CFDS|FAULT|FAIL|LEAK|OVERHEAT|WARNING|INOP|MEL)\b') OR NOT regexp_matches(x, '\b\d{1,2}[:.]\d{2}\b|\bBY\s+[A-Z]{3}\d{5}\b'))), ' '), '\s+', ' ', 'g')) AS out FROM wo""")
def clean_lines(spark, sf_dir):
    return work_orders(spark, sf_dir).select("wo_id", text.clean(F.col("defect")).alias("out"))


@query(r"SELECT wo_id, CASE WHEN regexp_matches(coalesce(action, ''), '\|\s*ACTION:') THEN trim(regexp_extract(replace(action, chr(10), '~'), '^(.*?)\|\s*ACTION:', 1)) ELSE trim(replace(coalesce(action, ''), chr(10), '~')) END AS defect_part, CASE WHEN regexp_matches(coalesce(action, ''), '\|\s*ACTION:') THEN trim(regexp_extract(replace(action, chr(10), '~'), '^.*?\|\s*ACTION:(.*)$', 1)) ELSE '' END AS action_part FROM wo")
def split_defect_action(spark, sf_dir):
    s = text.split_defect_action(F.regexp_replace("action", "\n", "~"))
    return work_orders(spark, sf_dir).select("wo_id", s["defect"].alias("defect_part"), s["action"].alias("action_part"))


@query("SELECT wo_id, sha1(coalesce(defect, '')) AS text_hash, sha1(coalesce(defect, '') || '||' || coalesce(action, '')) AS pair_hash FROM wo")
def sha1_keys(spark, sf_dir):
    return work_orders(spark, sf_dir).select("wo_id", text.text_hash(F.col("defect")).alias("text_hash"), text.pair_hash(F.col("defect"), F.col("action")).alias("pair_hash"))


@query(r"SELECT doc_id, CASE WHEN length(d) >= 4 THEN substr(d, 1, 2) || '-' || substr(d, 3, 2) END AS code FROM (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM documents)")
def ata4_from_digits(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", codes.ata04(F.col("text")).alias("code"))


@query("SELECT wo_id, CASE WHEN entered IS NOT NULL THEN substr(entered, 1, 2) END AS a2, entered AS a4 FROM wo")
def code_levels(spark, sf_dir):
    return work_orders(spark, sf_dir).select("wo_id", codes.ata2(F.col("entered")).alias("a2"), codes.ata4(F.col("entered")).alias("a4"))


_LINES = "l AS (SELECT DISTINCT lpad(CAST(21 + p_partkey % 60 AS VARCHAR), 2, '0') AS c2, lpad(CAST(p_size AS VARCHAR), 2, '0') AS c4, p_brand AS b FROM part)"


def code_lines(spark, sf_dir) -> DataFrame:
    """Lines `AA - name` and `AA-BB - name` made from parts."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lpad((21 + F.col("p_partkey") % 60).cast("string"), 2, "0").alias("c2"), F.lpad(F.col("p_size").cast("string"), 2, "0").alias("c4"))
    two = p.select(F.concat("c2", F.lit(" - SYSTEM "), "c2").alias("text")).distinct()
    four = p.select(F.concat("c2", F.lit("-"), "c4", F.lit(" - UNIT "), "c4", F.lit(" OF ASSEMBLY")).alias("text")).distinct()
    return two.union(four).withColumn("seq", F.xxhash64("text"))


@query(f"WITH {_LINES} SELECT DISTINCT c2 AS code, 'SYSTEM ' || c2 AS description, 2 AS level FROM l UNION SELECT DISTINCT c2 || '-' || c4, 'UNIT ' || c4 || ' OF ASSEMBLY', 4 FROM l")
def parse_levels(spark, sf_dir):
    return hierarchy.nodes(code_lines(spark, sf_dir)).select("code", "description", "level")


@query(f"WITH {_LINES} SELECT DISTINCT c2 || '-' || c4 AS code, 'SYSTEM ' || c2 || ' - UNIT ' || c4 || ' OF ASSEMBLY' AS title FROM l")
def hierarchy_titles(spark, sf_dir):
    return hierarchy.inherited(hierarchy.nodes(code_lines(spark, sf_dir))).where("level = 4").select("code", F.col("full").alias("title"))


@query(f"WITH {_LINES}, k AS (SELECT DISTINCT c2, c4 FROM l) SELECT c2 AS code, least(count(*), 10)::BIGINT AS n FROM k GROUP BY c2")
def children_rollup(spark, sf_dir):
    return hierarchy.children(hierarchy.nodes(code_lines(spark, sf_dir))).select("code", (F.size(F.split("includes", ", "))).cast("bigint").alias("n"))


@query("SELECT DISTINCT entered AS ata4, e.engine_type FROM wo, (SELECT 'IAE' AS engine_type UNION ALL SELECT 'PW11' UNION ALL SELECT NULL) e WHERE entered IS NOT NULL AND (CAST(substr(entered, 1, 2) AS INTEGER) >= 70) = (e.engine_type IS NOT NULL)")
def engine_fanout(spark, sf_dir):
    return hierarchy.engine_fanout(work_orders(spark, sf_dir).where("entered is not null").select(F.col("entered").alias("ata4")).distinct())


@query("SELECT wo_id, j AS similarity FROM (SELECT wo_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))), 6) ELSE 0.0 END AS j FROM (SELECT wo_id, list_filter(list_distinct(string_split(lower(d), ' ')), lambda x: x <> '') AS a, ['hyd', 'pump', 'leak'] AS b FROM (SELECT wo_id, regexp_replace(coalesce(defect, ''), '[^\\w\\s-]', '', 'g') AS d FROM wo)))")
def token_jaccard(spark, sf_dir):
    return work_orders(spark, sf_dir).select("wo_id", F.round(text.similarity(F.col("defect"), F.lit("HYD PUMP LEAK")), 6).alias("similarity"))


@query(r"""SELECT wo_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(
  regexp_extract_all(t, '(?i)\b(TSM|FIM|AMM|IPC|WDM|SRM)\s+[0-9-]+\b', 1),
  list_transform(regexp_extract_all(t, '(?i)\b(?:ECAM|EICAS|CAS|BITE|FWC)[-\s](?:FAULT|FAIL|WARN|TEST)\b'), lambda x: upper(regexp_replace(x, '\s', '-', 'g')))),
  regexp_extract_all(t, '(?i)\bATA\s*\d{2}[-\s]?\d{2}\b')))), ';') AS keywords
 FROM (SELECT wo_id, concat_ws(' ', defect, action) AS t FROM wo)""")
def tech_keywords(spark, sf_dir):
    return work_orders(spark, sf_dir).select("wo_id", F.array_join(text.technical_keywords(F.concat_ws(" ", "defect", "action")), ";").alias("keywords"))


# --- citations ------------------------------------------------------------------------------------------------


_SEQ_SQL = r"(?:\d{2}[- ]?\d{2}(?:[- ]?\d{2,3}){0,3}|\d{6,8})"


def _cited(source: str) -> str:
    """CTEs up to `cited` (t, priority, normalized, manual, ata04, source, place) of the distinct texts t that `source` selects.

    Without looking around: bare tasks and runs of digits take the characters beside them, which are doubled before.
    """
    return rf"""x AS (SELECT DISTINCT t FROM ({source})),
 y AS (SELECT t, regexp_replace(t, '(?i)\bCMM\s*[-:]?\s*{_SEQ_SQL}\b', ' ', 'g') AS rest FROM x),
 found AS (
  SELECT t, upper(regexp_extract(raw, '(?i)^(TSM|IPC|AMM|FIM|CMM|WDM|SRM)', 1)) AS manual, raw, regexp_extract(raw, '({_SEQ_SQL})$', 1) AS seq, 'prefix' AS source
   FROM (SELECT t, unnest(regexp_extract_all(t, '(?i)\b(?:TSM|IPC|AMM|FIM|CMM|WDM|SRM)\s*[-:]?\s*{_SEQ_SQL}\b')) AS raw FROM y)
  UNION ALL SELECT t, 'UNKNOWN', raw, raw, 'task'
   FROM (SELECT t, unnest(regexp_extract_all(regexp_replace(rest, '([^A-Za-z0-9-])', '\1\1', 'g'), '(?:^|[^A-Za-z0-9])(\d{{2}}-\d{{2}}(?:-\d{{2,3}}){{0,3}})(?:$|[^A-Za-z0-9])', 1)) AS raw FROM y)
  UNION ALL SELECT t, 'UNKNOWN', raw, raw, 'compact'
   FROM (SELECT t, unnest(regexp_extract_all(' ' || regexp_replace(rest, '[^0-9]+', '  ', 'g') || ' ', ' (\d{{6,8}}) ', 1)) AS raw FROM y) WHERE NOT (length(raw) = 8 AND (raw LIKE '19%' OR raw LIKE '20%'))),
 parts AS (SELECT *, regexp_replace(regexp_replace(seq, '[\s-]+', '-', 'g'), '^-|-$', '', 'g') AS written, regexp_replace(seq, '\D', '', 'g') AS d FROM found WHERE manual <> 'CMM'),
 norms AS (SELECT *, CASE WHEN regexp_matches(written, '^\d{{2}}-\d{{2}}(?:-\d{{2,3}})*$') THEN written
   WHEN length(d) % 2 = 0 THEN substr(d, 1, 2) || regexp_replace(substr(d, 3), '(\d{{2}})', '-\1', 'g')
   ELSE substr(d, 1, 2) || regexp_replace(substr(d, 3, length(d) - 5), '(\d{{2}})', '-\1', 'g') || '-' || right(d, 3) END AS normalized FROM parts),
 ranked AS (SELECT t, CASE manual WHEN 'TSM' THEN 1 WHEN 'IPC' THEN 2 WHEN 'AMM' THEN 3 WHEN 'FIM' THEN 4 WHEN 'UNKNOWN' THEN 5 ELSE 999 END AS priority, normalized, manual, substr(normalized, 1, 5) AS ata04, raw, source FROM norms),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY t, normalized ORDER BY priority, manual, raw, source) AS r FROM ranked),
 cited AS (SELECT t, priority, normalized, manual, ata04, source, row_number() OVER (PARTITION BY t ORDER BY priority, normalized) AS place FROM firsts WHERE r = 1)"""


_BOTH = "SELECT wo_id, concat_ws(chr(10), defect, action) AS t FROM wo"


@query(f", {_cited(_BOTH)} SELECT wo_id, priority, normalized, manual, ata04, source FROM ({_BOTH}) JOIN cited USING (t)")
def citations_exploded(spark, sf_dir):
    c = citations.with_citations(work_orders(spark, sf_dir), "defect", "action").select("wo_id", F.explode("citations").alias("c"))
    return c.select("wo_id", "c.priority", "c.normalized", "c.manual", "c.ata04", "c.source")


@query(r"SELECT wo_id, len(list_filter(regexp_extract_all(coalesce(action, ''), '\b(TSM|IPC|AMM|FIM|WDM|SRM)\s*[-:]?\s*\d{2}[- ]?\d{2}'), lambda x: true))::INTEGER AS n FROM wo")
def prefixed_counts(spark, sf_dir):
    return work_orders(spark, sf_dir).select("wo_id", F.regexp_count(F.coalesce("action", F.lit("")), F.lit(r"\b(TSM|IPC|AMM|FIM|WDM|SRM)\s*[-:]?\s*\d{2}[- ]?\d{2}")).alias("n"))


@query(f", {_cited(_BOTH)} SELECT wo_id, manual, ata04 AS code FROM ({_BOTH}) LEFT JOIN (SELECT * FROM cited WHERE place = 1) USING (t)")
def best_citation(spark, sf_dir):
    """The best citation of every work order, null if it has none."""
    best = text.on_distinct(work_orders(spark, sf_dir), ["defect", "action"], lambda d: d.withColumn("c", citations.best(F.concat_ws("\n", "defect", "action"))))
    return best.select("wo_id", "c.manual", F.col("c.ata04").alias("code"))


_ACTION = "SELECT wo_id, coalesce(action, '') AS t FROM wo"


@query(f", {_cited(_ACTION)} SELECT wo_id, count(normalized)::INTEGER AS n FROM ({_ACTION}) LEFT JOIN cited USING (t) GROUP BY wo_id")
def cmm_excluded(spark, sf_dir):
    """How many citations every action has; component manuals don't count, nor do their digits."""
    return citations.with_citations(work_orders(spark, sf_dir), "action").select("wo_id", F.size("citations").alias("n"))


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(' ' || replace(regexp_replace(text, '[^0-9]+', '  ', 'g'), ' ', '  ') || ' ', ' (\d{6,8}) ', 1), lambda x: NOT (length(x) = 8 AND (x LIKE '19%' OR x LIKE '20%'))))::INTEGER AS n FROM documents")
def compressed_refs(spark, sf_dir):
    found = F.filter(F.regexp_extract_all("text", F.lit(citations.COMPACT), F.lit(1)), lambda x: ~((F.length(x) == 8) & x.rlike("^(19|20)")))
    return _docs(spark, sf_dir).select("doc_id", F.size(found).alias("n"))


@query(f", {_cited(_BOTH)} SELECT priority, manual, count(*) AS n FROM ({_BOTH}) JOIN cited USING (t) GROUP BY priority, manual")
def priority_counts(spark, sf_dir):
    return citations_exploded(spark, sf_dir).groupBy("priority", "manual").agg(F.count("*").alias("n"))


# --- defects --------------------------------------------------------------------------------------------------

#: What the families look for, written out for DuckDB: patterns of ASCII characters. The one family that looks ahead
#: isn't among them: its words are found with what lies between, and none of the tables holds what it looks out for.
_HIT_SQL = {
    "corrective_strong": (
        r"\breplac(e|ed|ing|ement)\b|\brepair(ed|ing)?\b|\brectif(y|ied|ication)\b|\btroubleshoot(ing)?\b|\bmodif(y|ication|ied)\b|\bMEL\b|\bdeferr(al|ed)\b|"
        r"\b(embod(y|ied)|incorporat(e|ed)|accomplish(ed)?|comply\s+with|implement(ed)?|appl(ied|y))\b\s+(SB|Service\s+Bulletin)\b|"
        r"\b(embod(y|ied)|incorporat(e|ed)|accomplish(ed)?|comply\s+with|implement(ed)?|appl(ied|y))\b\s+(AD|Airworthiness\s+Directive)\b|"
        r"\bC/O\s+REPLAC(ED|E|ING|EMENT)\b|\bthay\b"
    ),
    "corrective_weak": (
        r"\bremove(d|al)?\b|\binstall(ed|ation)?\b"
    ),
    "no_finding": (
        r"\bno\s*(abnormalit(y|ies)|defect|fault|finding|discrepanc(y|ies))\b|\bfound\s*(serviceable|normal)\b|\bwithin\s+limits?\b|\bcheck\s+satis(factory)?\b|"
        r"\brecord(?:ed)?\s+(raised\s+)?(a\s+)?nrc(\s+or\s+wo)?\s*:\s*nil\b|\bno\s*crack\s*(?:found|detected)?\b"
    ),
    "cosmetic": (
        r"\bpaint\s*(peel|chip|flake|touch[- ]?up|scratch|flake)\b|\b(name\s*plate|placard|decal|stencil|label|marking)\s*(miss(ing)?|faded|worn|illegible)\b|"
        r"\bcosmetic\b|\bappearance\b"
    ),
    "natural_wear": (
        r"\b(tyre|tire)\s*(wear|worn|tread|scuff)\b|\bbrake\s*wear\b|\berosion\b|\bweather(ing)?\b"
    ),
    "scheduled_overhaul": (
        r"\b(send|sent)\s+for\s+(inspection|bench\s*test|overhaul|shop\s*visit|nrc)\b|\bremove(d)?\s+for\s+(inspection|overhaul|bench\s*test)\b"
    ),
    "rigging_servicing": (
        r"\brig(ging)?\b|\bshims?\b|\bshim(ming)?\b|\badjust(ed|ment|ing)?\b|\bcalibrat(e|ion|ed|ing)\b|\bapply\s+(a\s+)?thin\s+film\s+of\s+the\s+grease\b|"
        r"\bgrease\b|\blubricat(e|ion|ed)\b|\bclose[-\s]?up\b|\bopen\s+the\s+fan\s+cowls\b|\b(check\s+of\s+the\s+rigging|rigging\s+check)\b"
    ),
    "warn_ctx": (
        r"\b(ECAM|EICAS|CAS)\s+(warning|caution)\b|\bwarning\s*(light|message|caption|indication)\b|\bcaution\s*(light|message|caption|indication)\b"
    ),
    "strong_symptom": (
        r"\bfail(ure|ed)?\b|\bfault(s)?\b|\bmalfunction\b|\bleak(s|ing)?\b|\boverheat(ing)?\b|\bvibrat(e|ion|ing)\b|\bsmoke\b|\bintermittent\b|\bspurious\b|"
        r"\bno\s*go\b|\binop(erative)?\b|\bdegrad(ed|ation)\b|\bshort( circuit)?\b|\btrip(ped)?\b|\bcrack(s|ed)?\b|\bECAM\b|\bEICAS\b|\bCAS\b|\bACARS\b|\bFWS\b|"
        r"\brung\b"
    ),
    "routine_generic": (
        r"\b(clean(ing)?|lubricat(e|ion|ed)|servic(e|ing)|disinfection|interior clean|cabin tidy)\b|\b(periodic|scheduled|routine)\b|"
        r"\b(A-?check|C-?check|IL|4D|transit\s*check|daily\s*check|weekly\s*check|preflight\s*check|walkaround)\b|"
        r"\b(general|detailed|special)\s+visual\s+inspection\b|\b(zonal|zone)\s+(visual\s+)?inspection\b|\b(boroscope|borescope)\s+inspection\b|"
        r"\bvisual\s+inspection\b|\binspect(ion|ed|ing)?\b|\bperform\s+check(s)?\b|"
        r"\b(checks?|ops(\.|eration(al)?)?\s*(test|check)|functional\s*check|leak\s*check)\b|"
        r"\bref(er)?\s+amm\b.*\b(05|06|20[0-9]|200)\b[- ]?\d{2}([- ]?\d{2})?([- ]?\d{2,})?|\bamm\s+task\b|\bamm\b.*\b200[- ]?\d{3}\b|"
        r"\b(checks\s+scheduled|make\s+sure|refer\s+to)\b|\btheo\s*AMM\b"
    ),
    "instructional": (
        r"\b(look\s+for|check\s+for|inspect\s+for)\s+(crack(s)?|leak(s|age)?|damage|defect(s)?)\b|\bif\s+(any\s+)?crack\s+found\b|"
        r"\bif\s+there\s+is\s+contamination\b"
    ),
}
_CONTEXT_SQL = (
    r"\b(defect(s)?|damage(d)?|crack(s)?|cracked)\b.*?\b(found|detected|observed|reported|noted|occurred|present)\b|"
    r"\b(found|detected|observed|reported|noted|occurred|present)\b.*?\b(defect(s)?|damage(d)?|crack(s)?|cracked)\b"
)


def _hits_sql(column: str) -> str:
    every = {**_HIT_SQL, "defect_with_context": _CONTEXT_SQL}
    return ", ".join(f"len(regexp_extract_all({column}, '(?i){v}'))::INTEGER AS {k}" for k, v in every.items())


@query("SELECT wo_id, " + _hits_sql("coalesce(defect, '')") + " FROM wo")
def hit_counts(spark, sf_dir):
    h = defect.hit_counts(F.coalesce("defect", F.lit("")), ascii_only=True)
    found = text.on_distinct(work_orders(spark, sf_dir).select("wo_id", "defect"), ["defect"], lambda d: d.select("defect", *[h[k].alias(k) for k in (*_HIT_SQL, "defect_with_context")]))
    return found.drop("defect")


#: The scoring rules over distinct texts. Lines of paperwork in the tables are those of two kinds.
_RULES = f"""
raw AS (SELECT DISTINCT defect, action, wo_type FROM wo),
kept AS (SELECT *, trim(regexp_replace(array_to_string(list_filter(string_split(coalesce(defect, '') || chr(10) || coalesce(action, ''), chr(10)),
  lambda x: NOT regexp_matches(x, '(?i)\\b\\d{{1,2}}[:.]\\d{{2}}\\b|\\bBY\\s+[A-Z]{{3}}\\d{{5}}\\b') OR regexp_matches(x, '(?i){_HIT_SQL["strong_symptom"]}|{_HIT_SQL["warn_ctx"]}')), ' '), '\\s+', ' ', 'g')) AS t FROM raw),
h AS (SELECT *, {_hits_sql("t")}, regexp_matches(coalesce(wo_type, ''), '(?i)\\bSCHEDULED\\b|\\bROUTINE\\b|\\bCHECK\\b') AS sched FROM kept),
c AS (SELECT *, CASE WHEN instructional > 0 AND defect_with_context > 0 THEN defect_with_context - 1 ELSE defect_with_context END AS ctx,
  CASE WHEN sched AND (routine_generic > 0 OR scheduled_overhaul > 0) THEN 1 ELSE 0 END AS planned FROM h),
s AS (SELECT *, strong_symptom * 4.0 + warn_ctx * 3.0 + ctx * 3.2 + corrective_strong * 3.8 + corrective_weak * 0.8 AS defect_score,
  planned * 3.7 + routine_generic * 1.9 + rigging_servicing * 2.4 + no_finding * 2.8 + cosmetic * 3.0 + natural_wear * 2.5 + scheduled_overhaul * 2.5 AS nondef_score,
  sched OR routine_generic > 0 OR rigging_servicing > 0 AS upkeep FROM c),
r AS (SELECT *, CASE WHEN t = '' THEN 'empty'
  WHEN upkeep AND no_finding > 0 AND strong_symptom = 0 AND corrective_strong = 0 THEN 'scheduled_no_finding'
  WHEN strong_symptom > 0 AND no_finding > 0 AND upkeep THEN 'symptom_but_no_finding'
  WHEN strong_symptom > 0 THEN 'strong_symptom' WHEN corrective_strong > 0 THEN 'corrective_strong'
  WHEN sched AND (routine_generic > 0 OR scheduled_overhaul > 0 OR rigging_servicing > 0) AND ctx = 0 THEN 'scheduled_routine'
  WHEN nondef_score - defect_score >= 1.0 THEN 'score_nondefect' WHEN defect_score - nondef_score >= 1.0 THEN 'score_defect'
  WHEN sched AND no_finding > 0 AND (routine_generic > 0 OR rigging_servicing > 0) THEN 'tie_no_finding' ELSE 'safety_first' END AS rule FROM s),
j AS (SELECT wo_id, round(defect_score, 4)::DOUBLE AS defect_score, round(nondef_score, 4)::DOUBLE AS nondef_score,
  rule IN ('strong_symptom', 'corrective_strong', 'score_defect', 'safety_first') AS is_technical, rule
  FROM wo JOIN r ON wo.defect IS NOT DISTINCT FROM r.defect AND wo.action IS NOT DISTINCT FROM r.action AND wo.wo_type = r.wo_type)"""


@query(f", {_RULES} SELECT * FROM j -- wo")
def defect_scores(spark, sf_dir):
    c = defect.classify(work_orders(spark, sf_dir), "defect", "action", "wo_type")
    return c.select("wo_id", F.round("defect_score", 4).alias("defect_score"), F.round("nondef_score", 4).alias("nondef_score"), "is_technical", "rule")


@query(f", {_RULES} SELECT rule, is_technical, count(*) AS n FROM j GROUP BY rule, is_technical -- wo")
def rule_histogram(spark, sf_dir):
    return defect_scores(spark, sf_dir).groupBy("rule", "is_technical").agg(F.count("*").alias("n"))


#: The keyword patterns that can occur in the tables' texts, written out.
_ROUTINE_SQL = r"\broutine\b|\bpreventive\b|\bscheduled\s+(inspection|maintenance|service|check)\b|\b[acd]-check\b|\boverhaul\b|\b(life|time|cycle)\s+limit\b|\bsb\s+\d+|\bad\s+\d+|\b(normal|expected)\s+wear\b|\bwithin\s+(limits|tolerance)\b|\bserviceable\b|\bty(r|re)\s+(wear|worn|tread)\b|\bti(r|re)\s+(wear|worn|tread)\b|\bbrake\s+(wear|worn|pad)\b|\bpaint\s+(chip|scratch|peel)\b|\blubrication\b|\bgrease\b"
_DEFECT_SQL = r"\bfail(ed|ure)?\b|\bfault(y)?\b|\bdefect(ive)?\b|\bmalfunction\b|\binop(erative)?\b|\bu/s\b|\bdamage(d)?\b|\bcrack(ed|ing)?\b|\bbroken\b|\bleak(age|ing)?\b|\babnormal\b|\bexcessive\b|\becam\s+(caution|warning|fault)\b|\bwarning\b|\balert\b|\bcaution\b|\bmissing\b|\bloose\b|\boverheating\b|\bintermittent\b|\bnoise\b|\bvibration\b|\bsmoke\b"
_FOUND_SQL = r"\b(found|detected|discovered|identified|observed|noted|rectify|cmr)\b"


@query(f""", k AS (SELECT coalesce(defect, '') || ' ' || coalesce(action, '') AS t, contains(upper(wo_type), 'SCHEDULED') AND NOT contains(upper(wo_type), 'UNSCHEDULED') AS s FROM wo),
 m AS (SELECT s, regexp_matches(t, '(?i){_ROUTINE_SQL}') AS r, regexp_matches(t, '(?i){_DEFECT_SQL}') AS d, regexp_matches(t, '(?i){_FOUND_SQL}') AS f FROM k),
 v AS (SELECT CASE WHEN s AND r THEN 'scheduled routine' WHEN s AND f AND d THEN 'scheduled with finding' WHEN s AND d THEN 'scheduled with defect' WHEN s THEN 'scheduled' WHEN r THEN 'routine' WHEN d THEN 'defect' ELSE 'no keyword' END AS reason FROM m)
 SELECT reason, reason IN ('scheduled with finding', 'scheduled with defect', 'defect') AS is_technical_defect,
  (CASE reason WHEN 'scheduled routine' THEN 0.9 WHEN 'scheduled with finding' THEN 0.95 WHEN 'scheduled with defect' THEN 0.7 WHEN 'scheduled' THEN 0.8 WHEN 'routine' THEN 0.9 WHEN 'defect' THEN 0.9 ELSE 0.6 END)::DOUBLE AS confidence, count(*) AS n FROM v GROUP BY reason -- wo""")
def sched_ladder(spark, sf_dir):
    return defect.classify_keywords(work_orders(spark, sf_dir), "defect", "action", "wo_type").groupBy("reason", "is_technical_defect", "confidence").agg(F.count("*").alias("n"))


# --- TF-IDF ---------------------------------------------------------------------------------------------------

_TF = r"""t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM b), tf AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL),
 n AS (SELECT count(*) AS n FROM b), v AS (SELECT term, count(*) AS df, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM tf, n GROUP BY term),
 x AS (SELECT item_id, term, tf * idf AS x FROM tf JOIN v USING (term)), w AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM x)"""
_B = "b AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text FROM benchmark)"


def _bench(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("text"))


def _weights(spark, sf_dir):
    b = _bench(spark, sf_dir)
    counts = tfidf.term_counts(b, "item_id", "text", (1, 1))
    v = tfidf.fit(counts, b.count())
    return counts, v, tfidf.weigh(counts, "item_id", v)


@query(f"WITH {_B}, {_TF} SELECT term, df, round(idf, 6) AS idf FROM v")
def df_idf(spark, sf_dir):
    return _weights(spark, sf_dir)[1].withColumn("idf", F.round("idf", 6))


@query(f"WITH {_B}, {_TF} SELECT item_id, round(sqrt(sum(w * w)), 6) AS norm, count(*) AS terms FROM w GROUP BY item_id")
def doc_norms(spark, sf_dir):
    return _weights(spark, sf_dir)[2].groupBy("item_id").agg(F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm"), F.count("*").alias("terms"))


_SIM = "s AS (SELECT a.item_id AS q, b.item_id AS c, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY ALL)"


def _scores(spark, sf_dir):
    w = _weights(spark, sf_dir)[2]
    return tfidf.similarities(w.withColumnRenamed("item_id", "q"), w.withColumnRenamed("item_id", "c"), "q", "c").where("q <> c").withColumn("score", F.round("score", 6))


@query(f"WITH {_B}, {_TF}, {_SIM} SELECT q, c, score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS r FROM s WHERE score > 0) WHERE r <= 3")
def topk_match(spark, sf_dir):
    return tfidf.top_k(_scores(spark, sf_dir), "q", "c", 3)


@query(f"WITH {_B}, {_TF}, {_SIM} SELECT q, c, score, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS r FROM s WHERE score >= 0.05) WHERE r = 1")
def threshold_match(spark, sf_dir):
    return tfidf.top_k(_scores(spark, sf_dir), "q", "c", 1, 0.05)


@query()
def catalog_build(spark, sf_dir):
    c = catalog.build(memory(spark, sf_dir).select("hash", "ata04", "text").dropDuplicates(["hash", "ata04"]), spark.createDataFrame([("21-26", "AIR")], "ATA04 string, Title string"))
    return c.entries.select("ata04", "title", F.array_join("keywords", ";").alias("keywords"), F.array_join("samples", ";").alias("samples"))


@query()
def catalog_match(spark, sf_dir):
    m = memory(spark, sf_dir)
    c = catalog.build(m.select("hash", "ata04", "text").dropDuplicates(["hash", "ata04"]), spark.createDataFrame([("21-26", "AIR")], "ATA04 string, Title string"))
    q = work_orders(spark, sf_dir).select("defect", F.lit("").alias("action")).distinct().withColumn("q", F.sha1(F.coalesce("defect", F.lit(""))))
    return catalog.match(c, q, "q", "defect", "action", 1).select("q", "ata04", F.round("score", 6).alias("score"), "snippet")


@query(f"WITH {_LINES} SELECT DISTINCT c2 || '-' || c4 AS \"ATA04\", 'SYSTEM ' || c2 || ' - UNIT ' || c4 || ' OF ASSEMBLY' AS \"Titles\", c2 || '-' || c4 AS \"Keywords\", '' AS \"Sample_Phrases\", 'CATALOG' AS \"Source\", '' AS \"Notes\" FROM l")
def catalog_flat(spark, sf_dir):
    e = hierarchy.code_titles(hierarchy.nodes(code_lines(spark, sf_dir))).select(F.col("ATA04").alias("ata04"), F.col("Title").alias("title"), F.array(F.col("ATA04")).alias("keywords"), F.array().cast("array<string>").alias("samples"))
    return catalog.flatten_entries(e)


@query(r"SELECT item_id, token, n, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, token) AS r FROM (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[a-z0-9\-/.]{3,}')) AS token FROM benchmark) GROUP BY ALL)) WHERE r <= 12")
def catalog_keywords_top12(spark, sf_dir):
    return hierarchy.top_tokens(_bench(spark, sf_dir), "item_id", "text")


# --- decisions ------------------------------------------------------------------------------------------------

_MATRIX = """m AS (SELECT entered AS e0, CASE WHEN seq % 3 = 0 THEN entered WHEN seq % 3 = 1 THEN '32-41' END AS e1, CASE WHEN seq % 5 < 2 THEN entered WHEN seq % 5 = 2 THEN '32-41' END AS e2, (seq % 100) / 100.0 AS e2_score,
 CASE seq % 4 WHEN 0 THEN 'TSM' WHEN 1 THEN 'IPC' WHEN 2 THEN 'AMM' ELSE 'UNKNOWN' END AS e1_source, seq, wo_id FROM wo),
 d AS (SELECT *, e1 IS NOT NULL AS v FROM m),
 r AS (SELECT *, CASE WHEN v AND e1 = e2 AND e0 IS NOT DISTINCT FROM e1 THEN 'CONFIRM:0.97' WHEN v AND e1 = e2 THEN 'CORRECT:0.95' WHEN e2 = e0 AND NOT v THEN 'CONFIRM:0.86' WHEN v AND e2 IS NULL THEN 'CONFIRM:0.92'
  WHEN v AND e2 IS NOT NULL THEN 'REVIEW:' || CAST(round((CASE e1_source WHEN 'TSM' THEN 0.85 WHEN 'IPC' THEN 0.80 WHEN 'AMM' THEN 0.75 ELSE 0.70 END) * (CASE WHEN e2_score > 0.85 THEN 0.95 ELSE 1.0 END), 4)::DOUBLE AS VARCHAR)
  WHEN e0 IS NOT NULL AND e1 IS NULL AND e2 IS NULL THEN 'REVIEW:0.5' ELSE 'REVIEW:0.55' END AS x FROM d),
 z AS (SELECT *, split_part(x, ':', 1) AS decision, CAST(split_part(x, ':', 2) AS DOUBLE) AS confidence FROM r)"""


def matrix(spark, sf_dir) -> DataFrame:
    """Evidence in all combinations, from the rows' numbers."""
    s = F.col("seq")
    wo = work_orders(spark, sf_dir)
    m = wo.select(
        F.col("entered").alias("e0"),
        F.when(s % 3 == 0, F.col("entered")).when(s % 3 == 1, "32-41").alias("e1"),
        F.when(s % 5 < 2, F.col("entered")).when(s % 5 == 2, "32-41").alias("e2"),
        ((s % 100) / 100.0).alias("e2_score"),
        F.when(s % 4 == 0, "TSM").when(s % 4 == 1, "IPC").when(s % 4 == 2, "AMM").otherwise("UNKNOWN").alias("e1_source"),
        "seq",
        "wo_id",
    )
    return decision.decide_table(m.withColumn("e1_valid", F.col("e1").isNotNull()))


@query(f", {_MATRIX} SELECT wo_id, decision, round(confidence, 4) AS confidence FROM z -- wo")
def decide_matrix(spark, sf_dir):
    return matrix(spark, sf_dir).select("wo_id", "decision", F.round("confidence", 4).alias("confidence"))


@query(f""", {_MATRIX} SELECT wo_id, CASE WHEN decision = 'CONFIRM' THEN coalesce(e0, e1, e2) WHEN decision = 'CORRECT' THEN coalesce(e1, e2) WHEN e1_source IN ('TSM', 'IPC') AND e1 IS NOT NULL THEN e1
 WHEN e2_score > 0.8 THEN coalesce(e2, e1, e0) ELSE coalesce(e1, e2, e0) END AS recommended, coalesce(e1, e2, e0) AS final FROM z -- wo""")
def recommended_code(spark, sf_dir):
    return matrix(spark, sf_dir).select("wo_id", "recommended", "final")


@query(f""", {_MATRIX}, g AS (SELECT decision, CASE WHEN confidence > 0.90 THEN 'high' WHEN confidence >= 0.70 THEN 'medium' ELSE 'low' END AS band, e1_source AS source, confidence FROM z)
 SELECT CASE WHEN grouping(decision) = 0 THEN 'decision' WHEN grouping(band) = 0 THEN 'band' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS kind, coalesce(decision, band, source, 'all') AS name, count(*) AS n,
 round(avg(confidence), 4) AS avg_confidence FROM g GROUP BY GROUPING SETS ((decision), (band), (source), ()) -- wo""")
def decision_stats(spark, sf_dir):
    return decision.decision_stats(matrix(spark, sf_dir)).select("kind", "name", "n", F.round("avg_confidence", 4).alias("avg_confidence"))


@query()
def work_order_decisions(spark, sf_dir):
    wo = work_orders(spark, sf_dir)
    return decided(wo, cited_catalog(wo)).select("wo_id", "technical", "e0", "e1", "e1_source", "e2", "decision", F.round("confidence", 4).alias("confidence"), "recommended")


@query(f""", {_MATRIX}, u AS (SELECT *, coalesce(e1, e2, e0) AS final FROM z), q AS (SELECT * FROM u WHERE decision = 'REVIEW' OR confidence < 0.82 OR final IS NULL ORDER BY wo_id LIMIT 300),
 k AS (SELECT wo_id, e1 AS code, 1.0 AS score, 1 AS place FROM q WHERE e1 IS NOT NULL UNION ALL SELECT wo_id, e2, e2_score, 2 FROM q WHERE e2 IS NOT NULL UNION ALL SELECT wo_id, e0, 0.5, 3 FROM q WHERE e0 IS NOT NULL),
 f AS (SELECT wo_id, code, arg_min(score, place) AS score FROM k GROUP BY wo_id, code),
 b AS (SELECT wo_id, code, row_number() OVER (PARTITION BY wo_id ORDER BY score DESC, code) AS r FROM f)
 SELECT q.wo_id AS row_id, b.code AS choice FROM q LEFT JOIN b ON b.wo_id = q.wo_id AND b.r = 1""")
def arbiter_candidates(spark, sf_dir):
    m = matrix(spark, sf_dir).withColumn("technical", F.lit(True))
    e2s = F.when(F.col("e2").isNotNull(), F.array(F.struct(F.col("e2").alias("ata04"), F.col("e2_score").alias("score"))))
    unclear = decision.for_arbitration(m, "wo_id").select(F.col("wo_id").alias("row_id"), decision.candidates(F.col("e0"), F.col("e1"), e2s).alias("candidates"))
    return decision.arbitrate(unclear)
