"""The hierarchy of codes: levels of two to eight digits, inherited titles, rolled-up children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import clean_map_text
from .store import last_titles

# Engine tags of descriptions, and engines that chapters from 70 on are repeated for.
ENGINE_TAG = r"^\((?:IAE|PW11|PW|CFM|LEAP)[^)]*\)$"
ENGINES = ("IAE", "PW11")
FIRST_ENGINE_CHAPTER = 70


def nodes(lines: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """code, description, level, parent, seq of lines `code - description`; of a repeated code the last stands."""
    cleaned = lines.select(F.col(seq).alias("seq"), clean_map_text(F.col(text)).alias("t"))
    parsed = cleaned.select("seq", codes.parse_level(F.col("t")).alias("p")).where("p is not null")
    one = parsed.groupBy(F.col("p.code").alias("code")).agg(F.max_by("p.description", "seq").alias("description"), F.max("p.level").alias("level"), F.min("seq").alias("seq"))
    return one.select("code", "description", "level", parent("code", "level").alias("parent"), "seq")


def parent(code: str, level: str) -> Column:
    return F.when(F.col(level) > 2, F.regexp_replace(F.col(code), r"-\d{2}$", ""))


def merged(descriptions: Column) -> Column:
    """Parts of the descriptions from the root down, each once, joined by ` - `; an engine tag only if it is first."""
    parts = F.transform(F.flatten(F.transform(F.array_compact(descriptions), lambda d: F.split(d, r"\s*-\s*"))), lambda x: F.btrim(x))
    once = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.array_join(F.filter(once, lambda x, i: (i == 0) | ~x.rlike(ENGINE_TAG)), " - ")


def equipment(description: Column) -> Column:
    """The first three words without an engine tag."""
    bare = F.regexp_replace(description, r"\([^)]*\)\s*-\s*", "")
    return F.array_join(F.slice(F.split(F.btrim(bare), r"\s+"), 1, 3), " ")


def inherited(tree: DataFrame) -> DataFrame:
    """tree with `full`: descriptions from the root to the node. Three joins on the parent, as there are four levels."""
    up = tree.select(F.col("code").alias("k"), F.col("description").alias("d"), F.col("parent").alias("next"))
    out = tree.withColumn("_up", F.col("parent"))
    for i in range(3):
        step = up.select(F.col("k").alias("_up"), F.col("d").alias(f"_d{i}"), F.col("next").alias("_next"))
        out = out.join(step, "_up", "left").withColumn("_up", F.col("_next")).drop("_next")
    return out.withColumn("full", merged(F.array("_d2", "_d1", "_d0", "description"))).drop("_up", "_d0", "_d1", "_d2")


def children(tree: DataFrame, most: int = 10) -> DataFrame:
    """code, includes: `[Includes: ...]` of the first children in order."""
    below = tree.where("parent is not null").select(F.col("parent").alias("code"), "seq", equipment(F.col("description")).alias("e"))
    listed = below.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("seq", "e"))).alias("c"))
    return listed.select("code", F.concat(F.lit("[Includes: "), F.array_join(F.transform(F.slice("c", 1, most), lambda x: x["e"]), ", "), F.lit("]")).alias("includes"))


def code_titles(tree: DataFrame) -> DataFrame:
    """ATA04, Title of every four-digit code: inherited description and what it includes."""
    four = inherited(tree).where("level = 4").join(children(tree), "code", "left")
    return four.select(codes.first_two(F.col("code")).alias("ATA04"), F.concat_ws(" ", "full", "includes").alias("Title"))


def enriched(entries: DataFrame, code_map: DataFrame) -> DataFrame:
    """Catalog entries with the map's title where it has one."""
    known = code_map.groupBy(F.col("ATA04").alias("ata04")).agg(F.max("Title").alias("_t"))
    return entries.join(known, "ata04", "left").withColumn("title", F.coalesce("_t", "title")).drop("_t")


def engine_fanout(docs: DataFrame, code: str = "ata4", engines=ENGINES) -> DataFrame:
    """Rows of chapters from 70 on once for each engine, others once without one; distinct."""
    chapter = F.substring(F.col(code), 1, 2).cast("int")
    kinds = F.when(chapter >= FIRST_ENGINE_CHAPTER, F.array(*[F.lit(e) for e in engines])).otherwise(F.array(F.lit(None).cast("string")))
    return docs.withColumn("engine_type", F.explode(kinds)).distinct()


def group_records(records: DataFrame, seq: str = "seq") -> DataFrame:
    """ata4, text of records(ata2, ata4, ata6, title, description, seq): titles, descriptions and child tags in order."""
    four = F.coalesce("ata4", F.substring("ata6", 1, 5))
    rows = records.withColumn("_4", four).where("_4 is not null")
    tag = F.when(F.col("ata6").isNotNull(), F.concat(F.lit("[CHILD:"), F.col("ata6"), F.lit("]")))
    part = F.concat_ws(" ", F.nullif(F.btrim("title"), F.lit("")), F.nullif(F.btrim("description"), F.lit("")), tag)
    grouped = rows.groupBy(F.col("_4").alias("ata4")).agg(F.array_sort(F.collect_list(F.struct(F.col(seq), part.alias("p")))).alias("c"))
    head = F.concat(F.lit("[ATA4:"), F.col("ata4"), F.lit("]"))
    return grouped.select("ata4", F.concat_ws("\n", head, F.transform("c", lambda x: x["p"])).alias("text"))


def top_tokens(docs: DataFrame, key: str, text: str, k: int = 12) -> DataFrame:
    """key, token, n: the k most frequent tokens `[a-z0-9-/.]{3,}` of each document, ties by token."""
    rows = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[a-z0-9\-/.]{3,}"), F.lit(0))).alias("token"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "token"))
    return rows.groupBy(key, "token").agg(F.count("*").alias("n")).withColumn("rank", rank).where(F.col("rank") <= k)


def class_starts(docs: DataFrame, key: str, text: str, order: str, cut: int) -> DataFrame:
    """key, text: the first `cut` characters of a class's documents in order, a blank line between them.

    Only documents that begin within them are brought together, so that a class's row is bounded.
    """
    before = Window.partitionBy(key).orderBy(order, text).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 2).over(before), F.lit(0))
    rows = docs.select(key, order, F.substring(F.coalesce(text, F.lit("")), 1, cut).alias("_t"), start.alias("_start")).where(F.col("_start") < cut)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("_t")))), lambda x: x["_t"]), "\n\n")
    return rows.groupBy(key).agg(F.substring(joined, 1, cut).alias(text))


def enriched_items(docs: DataFrame, names: DataFrame, cut: int = 1200) -> DataFrame:
    """ata4, name, engine_type, keywords, sample of docs(ata4, text, o): the enriched catalog's items, texts in the order of o."""
    words = top_tokens(docs, "ata4", "text").groupBy("ata4").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("keywords"))
    starts = class_starts(docs, "ata4", "text", "o", cut).withColumnRenamed("text", "sample")
    named = starts.join(words, "ata4", "left").join(last_titles(names).toDF("ata4", "name"), "ata4", "left")
    return engine_fanout(named.select("ata4", "name", "keywords", "sample")).select("ata4", "name", "engine_type", "keywords", "sample")


def enriched_json(items: DataFrame, version: str = "1", generated_by: str = "tarmac") -> DataFrame:
    """value: the enriched catalog as one JSON object. The number of codes bounds it."""
    row = F.struct("ata4", "name", "engine_type", "keywords", "sample")
    return items.agg(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(generated_by).alias("generated_by"), F.count("*").alias("count"), F.array_sort(F.collect_list(row)).alias("items"))).alias("value"))
