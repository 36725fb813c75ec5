"""The work-order memory and the code map: incremental deduplication, statistics, atomic writes."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import compose, text_hash

MEMORY = "text string, ata04 string, hash string"
MAP = "ATA04 string, Title string"
META = "source_file string, rows_ingested int, ingested_at timestamp"


def keep_first(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row of each key: the first in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def label(final: Column, entered: Column) -> Column:
    """The final code if it isn't blank, else the entered one, as AA-BB."""
    return codes.ata04(F.coalesce(F.nullif(F.btrim(final), F.lit("")), entered))


def training_rows(df: DataFrame, defect: str, action: str, final: str | None, entered: str) -> DataFrame:
    """text, ata04, hash of rows with a text and a code."""
    text = compose(F.col(defect), F.col(action))
    code = label(F.col(final) if final else F.lit(None).cast("string"), F.col(entered))
    return df.select(text.alias("text"), code.alias("ata04")).where((F.length("text") > 0) & F.col("ata04").isNotNull()).withColumn("hash", text_hash(F.col("text")))


def new_rows(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of fresh whose hash the memory doesn't have, one for each hash: the first in fresh's order."""
    return keep_first(in_order(fresh), ["hash"], "_seq").join(memory.select("hash"), "hash", "left_anti").select("text", "ata04", "hash")


def in_order(df: DataFrame) -> DataFrame:
    """df with `_seq`, which follows the order of its partitions and rows."""
    return df.withColumn("_seq", F.monotonically_increasing_id())


def last_titles(code_map: DataFrame) -> DataFrame:
    """ata04, title: the last row's title of each code."""
    return in_order(code_map).groupBy(F.col("ATA04").alias("ata04")).agg(F.max_by("Title", "_seq").alias("title"))


def merged(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """Memory with fresh rows: an old row wins over a new one."""
    both = memory.withColumn("_gen", F.lit(0)).unionByName(fresh.withColumn("_gen", F.lit(1)))
    return keep_first(both, ["hash"], "_gen", "ata04", "text").drop("_gen")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Union of both in which the newest row of each key stands."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, F.desc("_gen"), *[F.desc(c) for c in order]).drop("_gen")


def stats(memory: DataFrame) -> DataFrame:
    return memory.agg(F.count("*").alias("n_rows"), F.count_distinct("ata04").alias("n_classes"), F.round(F.avg(F.length("text")), 2).alias("avg_length"))


def class_counts(memory: DataFrame, top: int | None = None) -> DataFrame:
    out = memory.groupBy("ata04").agg(F.count("*").alias("docs"))
    return out.orderBy(F.desc("docs"), "ata04").limit(top) if top else out


def class_summary(memory: DataFrame, min_docs: int) -> DataFrame:
    """Sum, mean, smallest and largest class, and how many are below min_docs."""
    return class_counts(memory).agg(F.sum("docs").alias("total"), F.avg("docs").alias("mean"), F.min("docs").alias("least"), F.max("docs").alias("most"), F.count_if(F.col("docs") < min_docs).alias("below"))


def coverage(memory: DataFrame, code_map: DataFrame) -> DataFrame:
    """Share, in percent, of the memory's codes that the map has."""
    have = code_map.select(F.col("ATA04").alias("ata04")).distinct().withColumn("known", F.lit(1.0))
    return memory.select("ata04").distinct().join(have, "ata04", "left").agg(F.round(F.avg(F.coalesce("known", F.lit(0.0))) * 100, 2).alias("coverage_percent"))


def capped(memory: DataFrame, most: int = 2000, seed: int = 42) -> DataFrame:
    """At most `most` documents of each class, chosen by a hash with the seed: the same whenever it runs."""
    rank = F.row_number().over(Window.partitionBy("ata04").orderBy(F.xxhash64("hash", F.lit(seed)), "hash"))
    return memory.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def locked(spark: SparkSession, path: str, timeout: float = 30.0):
    """One writer at a time: holds a lock file beside the table, which only one of several writers can create.

    TimeoutError if it isn't free in time; a lock that a lost writer left has to be deleted by hand.
    """
    lock, fs = _path(spark, f"{path}.lock")
    began = time.monotonic()
    while not _created(fs, lock):
        if time.monotonic() - began > timeout:
            raise TimeoutError(f"{path}.lock is held by another writer")
        time.sleep(0.1)
    try:
        yield
    finally:
        fs.delete(lock, False)


def _created(fs, lock) -> bool:
    try:
        return fs.createNewFile(lock)
    except Exception:  # some file systems raise for a file that is there
        return False


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement that was broken off between its two renames: the whole new table goes to the path."""
    p, fs = _path(spark, path)
    if fs.exists(p):
        return
    for kind in ("new", "old"):
        for s in fs.globStatus(_path(spark, f"{path}.{kind}-*")[0]) or []:
            if fs.exists(_path(spark, f"{s.getPath().toString()}/_SUCCESS")[0]) and fs.rename(s.getPath(), p):
                return


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one if there is none yet."""
    recover(spark, path)
    p, fs = _path(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> None:
    """Write beside the table and rename; df may read from path. read_or_empty finishes what a crash broke off."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    swap(df.sparkSession, new, path)


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder `new` in the place of the one at path, which goes last."""
    (a, fs), (p, _), (old, _) = _path(spark, new), _path(spark, path), _path(spark, f"{path}.old-{uuid.uuid4().hex}")
    if fs.exists(p):
        fs.rename(p, old)
    if not fs.rename(a, p):
        raise OSError(f"{new} couldn't be renamed to {path}")
    fs.delete(old, True)


def append_training(spark: SparkSession, fresh: DataFrame, path: str, source: str, meta_path: str | None = None) -> int:
    """Append what is new to the memory at path, and a line to the ingest log; old files aren't rewritten."""
    with locked(spark, path):
        rows = new_rows(read_or_empty(spark, path, MEMORY), fresh).persist()
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(path)
        rows.unpersist()
    if meta_path:
        spark.range(1).select(F.lit(source).alias("source_file"), F.lit(n).cast("int").alias("rows_ingested"), F.current_timestamp().alias("ingested_at")).write.mode("append").parquet(meta_path)
    return n


def append_map(spark: SparkSession, fresh: DataFrame, path: str) -> None:
    """Merge titles into the map: the newest title of a code stands, of several new ones the last."""
    with locked(spark, path):
        both = upsert_latest(in_order(read_or_empty(spark, path, MAP)), in_order(fresh), ["ATA04"], "_seq")
        replace(both.select("ATA04", "Title"), path)


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite the memory with one row of each hash; returns how many went."""
    with locked(spark, path):
        old = read_or_empty(spark, path, MEMORY)
        before = old.count()
        replace(keep_first(old, ["hash"], "ata04", "text"), path)
    return before - spark.read.parquet(path).count()


def init_tables(spark: SparkSession) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS wo_meta ({META}) USING parquet")


def missing_columns(df: DataFrame, needed: set[str]) -> set[str]:
    return needed - set(df.columns)
