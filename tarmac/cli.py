"""Command line: build a catalog, classify work orders, merge and validate a code map, ingest a folder, migrate and tidy a cache, show statistics."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cache, catalog, decision, detect, maintenance, store
from .plans import registry
from .sources import files, xlsx
from .streaming import ingest


def read(spark: SparkSession, path: str, sheet: str | None = None):
    if path.rsplit(".", 1)[-1].lower() in ("xlsx", "xlsm"):
        return xlsx.read(spark, path, sheet)
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def build(spark, a) -> None:
    c = catalog.build(spark.read.parquet(a.memory), store.read_or_empty(spark, a.map, store.MAP))
    catalog.save(c, a.out)
    catalog.catalog_stats(c.entries).show()


def classify(spark, a) -> None:
    raw = read(spark, a.input)
    wo = detect.internal(raw).withColumn("wo_id", F.monotonically_increasing_id().cast("string"))
    wo = wo.select("wo_id", F.col("Defect_Text").alias("defect"), F.col("Rectification_Text").alias("action"), F.col("WO_Type").alias("wo_type"), F.col("ATA04_Entered").alias("entered"))
    registry.decided(wo, catalog.load(spark, a.catalog) if a.catalog else None).write.mode("overwrite").parquet(a.out)
    decision.decision_stats(spark.read.parquet(a.out)).show(50, False)


def merge_map(spark, a) -> None:
    store.append_map(spark, files.code_map(spark, a.input, a.column), a.out)


def validate(spark, a) -> None:
    detect.validate_map(read(spark, a.input)).show()


def migrate(spark, a) -> None:
    print(maintenance.migrate_cache(spark, a.input, a.out))


def tidy(spark, a) -> None:
    print(cache.cleanup(spark, a.cache, int(time.time())), cache.vacuum(spark, a.cache))


def sync(spark, a) -> None:
    schema = "defect string, action string, final string, entered string"
    ingest.ingest_stream(ingest.watch(spark, a.input, schema), a.out, a.checkpoint, "defect", "action", "final", "entered").awaitTermination()


def show_stats(spark, a) -> None:
    memory = spark.read.parquet(a.memory)
    store.stats(memory).show()
    store.class_counts(memory, 20).show()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tarmac", description=__doc__)
    sub = p.add_subparsers(required=True)
    for name, run, options in (
        ("build", build, {"--memory": 1, "--map": 1, "--out": 1}),
        ("classify", classify, {"--input": 1, "--catalog": 0, "--out": 1}),
        ("map", merge_map, {"--input": 1, "--column": 0, "--out": 1}),
        ("validate", validate, {"--input": 1}),
        ("migrate", migrate, {"--input": 1, "--out": 1}),
        ("tidy", tidy, {"--cache": 1}),
        ("sync", sync, {"--input": 1, "--out": 1, "--checkpoint": 1}),
        ("stats", show_stats, {"--memory": 1}),
    ):
        s = sub.add_parser(name)
        for option, needed in options.items():
            s.add_argument(option, required=bool(needed))
        s.set_defaults(run=run)
    a = p.parse_args(argv)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
