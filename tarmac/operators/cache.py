"""A cache of answers with a time to live: key, value (JSON), ts, ttl (seconds, 0: for ever), model, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep_first, locked, read_or_empty, replace, upsert_latest

SCHEMA = "key string, value string, ts bigint, ttl bigint, model string, tokens int"


def expired(now: Column | int) -> Column:
    now = F.lit(now) if isinstance(now, int) else now
    return (F.col("ttl") > 0) & (now - F.col("ts") > F.col("ttl"))


def lookup(cache: DataFrame, keys: DataFrame, now: Column | int) -> DataFrame:
    """key, value for every key asked for; null if it isn't there or has expired."""
    return keys.join(cache.where(~expired(now)).select("key", "value"), "key", "left")


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Cache with rows written over it; of repeated keys the latest ts stands."""
    return upsert_latest(cache, keep_first(rows, ["key"], F.desc("ts"), "value"), ["key"], "ts")


def live(cache: DataFrame, now: Column | int) -> DataFrame:
    return cache.where(~expired(now))


def count_expired(cache: DataFrame, now: Column | int) -> DataFrame:
    return cache.agg(F.count_if(expired(now)).alias("n_expired"))


def stats(cache: DataFrame, now: Column | int) -> DataFrame:
    return cache.agg(
        F.count("*").alias("total"),
        F.count_if(expired(now)).alias("expired"),
        F.count_if(~expired(now)).alias("active"),
        F.round(F.coalesce(F.sum(F.length("value")), F.lit(0)) / 1048576.0, 2).alias("mb"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"),
    )


def by_model(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model").agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens")).orderBy(F.desc("n"), "model")


def migrated(old: DataFrame) -> DataFrame:
    """Rows of an older cache whose value is JSON, the latest of each key."""
    return keep_first(old.where(F.expr("try_parse_json(value) IS NOT NULL")), ["key"], F.desc("ts"))


def cleanup(spark, path: str, now: int) -> int:
    """Rewrite the cache at path without its expired entries; returns how many went."""
    return _rewrite(spark, path, lambda c: live(c, now))


def clear(spark, path: str) -> int:
    """Leave an empty cache at path; returns how many entries went."""
    return _rewrite(spark, path, lambda c: c.where("1 = 0"))


def vacuum(spark, path: str, files: int = 1) -> int:
    """Rewrite the cache at path with the latest entry of each key, in few files; returns how many rows went."""
    return _rewrite(spark, path, lambda c: keep_first(c, ["key"], F.desc("ts"), "value").coalesce(files))


def _rewrite(spark, path: str, make) -> int:
    with locked(spark, path):
        old = read_or_empty(spark, path, SCHEMA)
        before = old.count()
        replace(make(old), path)
    return before - read_or_empty(spark, path, SCHEMA).count()
