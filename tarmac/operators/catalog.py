"""Catalog of codes: built from the work-order memory, matched against new texts, flattened for export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import clean, normalize_case
from . import store, tfidf


@dataclass
class Catalog:
    """entries(ata04, title, keywords, samples), postings(ata04, term, w), vocabulary(term, df, idf)."""

    entries: DataFrame
    postings: DataFrame
    vocabulary: DataFrame


def build(memory: DataFrame, code_map: DataFrame, top_k: int = 15, sample_k: int = 3, max_docs: int = 2000, seed: int = 42, max_features: int = 50_000) -> Catalog:
    """Keywords, samples and title of every class, and the TF-IDF of one document made of them for each class.

    What several later steps read is persisted, so that texts are cleaned and cut once; a lost executor's part is
    made again from its lineage.
    """
    docs = store.capped(memory, max_docs, seed).select("hash", "ata04", normalize_case(F.col("text")).alias("text")).where("text <> ''").persist()
    n = docs.count()
    counts = tfidf.term_counts(docs, "hash", "text").persist()
    weights = tfidf.weigh(counts, "hash", tfidf.fit(counts, n, min_df=2, max_features=max_features)).persist()
    words = tfidf.class_keywords(weights, docs, "hash", "ata04", top_k)
    texts = tfidf.class_samples(weights, docs, "hash", "ata04", "text", sample_k)
    listed = words.groupBy("ata04").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    sampled = texts.groupBy("ata04").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample"))), lambda x: x["sample"]).alias("samples"))
    none = F.array().cast("array<string>")
    entries = docs.select("ata04").distinct().join(listed, "ata04", "left").join(sampled, "ata04", "left").join(store.last_titles(code_map), "ata04", "left")
    entries = entries.select("ata04", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("keywords", none).alias("keywords"), F.coalesce("samples", none).alias("samples"))
    return index(entries.persist())


def index(entries: DataFrame) -> Catalog:
    """Postings of entries: a class's document is its title, keywords and samples, or its code if it has none."""
    joined = F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.concat_ws(" ", "keywords"), F.concat_ws(" ", "samples"))
    docs = entries.select("ata04", F.when(F.trim(joined) == "", F.col("ata04")).otherwise(joined).alias("doc"))
    counts = tfidf.term_counts(docs, "ata04", "doc").persist()
    vocabulary = tfidf.fit(counts, docs.count()).persist()
    return Catalog(entries, tfidf.weigh(counts, "ata04", vocabulary).persist(), vocabulary)


def snippet() -> Column:
    """Title, else the first keyword, else the first sample."""
    return F.coalesce(F.nullif(F.col("title"), F.lit("")), F.get("keywords", F.lit(0)), F.get("samples", F.lit(0)))


def match(catalog: Catalog, queries: DataFrame, key: str, defect: str, action: str, k: int = 3, least: float = 0.0) -> DataFrame:
    """key, ata04, score, rank, snippet: the k best classes of every query with a score above 0, `least` or more."""
    text = F.trim(F.concat_ws(" ", clean(F.col(defect)), clean(F.col(action))))
    counts = tfidf.term_counts(queries.select(key, text.alias("_q")).where("_q <> ''"), key, "_q")
    scores = tfidf.similarities(tfidf.weigh(counts, key, catalog.vocabulary), catalog.postings, key, "ata04")
    return tfidf.top_k(scores, key, "ata04", k, least).join(catalog.entries.select("ata04", snippet().alias("snippet")), "ata04").select(key, "ata04", "score", "rank", "snippet")


def predict(catalog: Catalog, spark, defect: str, action: str, k: int = 3) -> DataFrame:
    """Matches of one pair of texts; none for blank texts."""
    return match(catalog, spark.createDataFrame([("q", defect, action)], "id string, defect string, action string"), "id", "defect", "action", k)


def save(catalog: Catalog, path: str) -> None:
    for name in ("entries", "postings", "vocabulary"):
        store.replace(getattr(catalog, name), f"{path}/{name}")


def load(spark, path: str) -> Catalog:
    """A saved catalog; raises if entries and postings disagree about the number of classes."""
    c = Catalog(*[spark.read.parquet(f"{path}/{name}") for name in ("entries", "postings", "vocabulary")])
    if c.entries.count() != c.postings.select("ata04").distinct().count():
        raise ValueError("catalog entries and postings don't belong together")
    return c


def to_json(entries: DataFrame) -> DataFrame:
    """value: one JSON object, code -> title, keywords, samples. For catalogs, whose size is that of the code list."""
    pair = F.struct("ata04", F.struct("title", "keywords", "samples"))
    return entries.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair)))).alias("value"))


_ENTRY = "struct<title:string,keywords:array<string>,samples:array<string>>"
_ITEM = "struct<ata4:string,name:string,engine_type:string,keywords:array<string>,sample:string>"
FLAT = ("ATA04", "Titles", "Keywords", "Sample_Phrases", "Source", "Notes")


def from_json(text: DataFrame) -> DataFrame:
    """Entries from a column `value` of JSON as to_json makes it."""
    rows = text.select(F.explode(F.from_json("value", f"map<string,{_ENTRY}>")).alias("ata04", "e"))
    return rows.select("ata04", "e.*")


def _flat(code: Column, title: Column, keywords: Column, samples: Column, source: Column) -> list[Column]:
    return [codes.catalog_code(code).alias("ATA04"), title.alias("Titles"), F.array_join(keywords, "; ").alias("Keywords"), F.array_join(samples, "; ").alias("Sample_Phrases"), source.alias("Source"), F.lit("").alias("Notes")]


def flatten_entries(entries: DataFrame) -> DataFrame:
    """A catalog as one row of strings for each code, sorted by code."""
    return entries.select(*_flat(F.col("ata04"), F.col("title"), F.col("keywords"), F.col("samples"), F.lit("CATALOG"))).where(F.col("ATA04").isNotNull()).orderBy("ATA04")


def flatten_json(text: DataFrame) -> DataFrame:
    """The same from JSON in a column `value`: a map by code, an enriched catalog with `items`, or a list of entries."""
    items = text.select(F.explode(F.from_json("value", f"struct<items:array<{_ITEM}>>")["items"]).alias("i")).select("i.*")
    listed = text.where(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", f"array<{_ITEM}>")).alias("i")).select("i.*")
    every = items.unionByName(listed)
    one = every.select(*_flat(F.col("ata4"), F.col("name"), F.col("keywords"), F.array_compact(F.array("sample")), F.coalesce("engine_type", F.lit("ENRICHED"))))
    plain = text.where(~F.col("value").rlike(r'^\s*(?:\[|\{\s*"(?:items|version|generated_by|count)")'))
    return one.unionByName(flatten_entries(from_json(plain))).where(F.col("ATA04").isNotNull()).orderBy("ATA04", "Source")


def catalog_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n"), F.avg(F.size("keywords")).alias("avg_keywords"), F.avg(F.size("samples")).alias("avg_samples"))


def prerequisites(memory: DataFrame, min_rows: int = 100, warn_rows: int = 1000, min_classes: int = 10) -> DataFrame:
    """status of a memory for building: error, warning or ok."""
    s = store.stats(memory)
    return s.withColumn("status", F.when((F.col("n_rows") < min_rows) | (F.col("n_classes") < min_classes), "error").when(F.col("n_rows") < warn_rows, "warning").otherwise("ok"))
