"""Upkeep of stored tables: backup, rollback, integrity, migration; and the enrichment run as a whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations
from . import cache, hierarchy, store


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def copy_tree(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a folder within Spark's file systems; False if there is nothing to copy."""
    a, fs = _fs(spark, source)
    b, other = _fs(spark, target)
    if not fs.exists(a):
        return False
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, True, spark._jsc.hadoopConfiguration())


def backup(spark: SparkSession, tables: dict[str, str], target: str) -> list[str]:
    """Copy named tables beneath target with a manifest of what was there; returns their names."""
    found = [name for name, path in sorted(tables.items()) if copy_tree(spark, path, f"{target}/{name}")]
    manifest = json.dumps({"tables": {n: tables[n] for n in found}})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/manifest")
    return found


def rollback(spark: SparkSession, source: str) -> list[str]:
    """Put the tables of a backup back where they were; a table goes only when its copy is whole."""
    tables = json.loads(spark.read.text(f"{source}/manifest", wholetext=True).head()["value"])["tables"]
    for name, path in tables.items():
        if not copy_tree(spark, f"{source}/{name}", f"{path}.new-back"):
            raise OSError(f"backup of {name} couldn't be copied")
        store.swap(spark, f"{path}.new-back", path)
    return sorted(tables)


def integrity(df: DataFrame, needed: set[str]) -> DataFrame:
    """n_rows, missing (columns), ok of a table."""
    missing = sorted(store.missing_columns(df, needed))
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(", ".join(missing)).alias("missing"), F.lit(not missing).alias("ok"))


def migrate_cache(spark: SparkSession, old: str, new: str) -> int:
    """Move an older cache into the new form, rows without valid JSON left out; returns how many came over."""
    store.replace(cache.migrated(spark.read.schema(cache.SCHEMA).parquet(old)), new)
    return spark.read.parquet(new).count()


def citation_tally(cases: DataFrame) -> DataFrame:
    """passed, failed of cases (text, expected code or null) under the citation extractor."""
    got = citations.best(F.col("text"))["ata04"]
    return cases.agg(F.count_if(got.eqNullSafe(F.col("expected"))).alias("passed"), F.count_if(~got.eqNullSafe(F.col("expected"))).alias("failed"))


def enrich(records: DataFrame, code_map: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Items of the enriched catalog from records of unstructured sheets and, if given, history (ata4, text)."""
    docs = hierarchy.group_records(records).withColumn("o", F.lit(0))
    if history is not None:
        docs = docs.unionByName(history.select("ata4", "text").withColumn("o", F.lit(1)))
    return hierarchy.enriched_items(docs, code_map)
