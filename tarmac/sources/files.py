"""Other scans and sinks: unstructured sheets, listings, manifests, JSON, CSV, bundles."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import clean_map_text, strip
from ..operators import hierarchy, store
from ..operators.detect import first_existing, with_clean_names
from . import xlsx

MANIFEST = "struct<by_id:map<string,struct<name:string,modified:string,path:string,kind:string,time_synced:string>>>"
# Sheets that may hold the code map, in order.
MAP_SHEETS = ("ATA", "Data", "Sheet1")


def unstructured(cells: DataFrame) -> DataFrame:
    """ata2, ata4, ata6, title, description, seq of rows of cells: codes anywhere in a row; the title is the first
    cell with the deepest code, the description the other cells."""
    full = F.filter(F.transform("cells", lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    rows = cells.select("path", "sheet", "row", full.alias("c")).where(F.size("c") > 0)
    text = F.array_join("c", " | ")
    found = rows.select("*", codes.ata6(text).alias("ata6"), codes.ata4(text).alias("ata4"), codes.ata2(text).alias("ata2"))
    deepest = F.regexp_replace(F.coalesce("ata6", "ata4", "ata2"), "-", "[- ]?")
    titled = found.withColumn("title", F.get(F.filter("c", lambda x: F.regexp_like(x, deepest)), F.lit(0)))
    rest = F.array_join(F.filter("c", lambda x: ~x.eqNullSafe(F.col("title"))), " | ")
    seq = F.row_number().over(Window.partitionBy("path").orderBy("sheet", "row"))
    return titled.select("ata2", "ata4", "ata6", "title", rest.alias("description"), "path", "sheet", "row", seq.alias("seq")).where("ata2 is not null or ata4 is not null or ata6 is not null")


def map_sheet(spark: SparkSession, path: str) -> str | None:
    """The first of MAP_SHEETS that the workbook has, else None for its first sheet."""
    have = {r["sheet"] for r in xlsx.read_cells(spark, path).select("sheet").distinct().collect()}
    return next((s for s in MAP_SHEETS if s in have), None)


def code_map(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """ATA04, Title of a workbook's code column (or the first whose values are codes)."""
    df = with_clean_names(xlsx.read(spark, path, map_sheet(spark, path)))
    if column is None:
        probe = df.limit(10).select([F.count_if(clean_map_text(F.col(f"`{c}`")).rlike(r"^\d{2}")).alias(c) for c in df.columns]).head()
        column = next((c for c in df.columns if probe[c]), df.columns[0])
    lines = df.select(F.col(f"`{column}`").alias("text"), F.monotonically_increasing_id().alias("seq")).where(F.col("text").isNotNull())
    return hierarchy.code_titles(hierarchy.nodes(lines))


def listing(spark: SparkSession, path: str, pattern: str = "*.xls*") -> DataFrame:
    """path, name, modified, bytes of files that match; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy("name")


def manifest_rows(text: DataFrame) -> DataFrame:
    """id, name, modified, path, kind, time_synced from a column `value` of JSON, by name."""
    return text.select(F.explode(F.from_json("value", MANIFEST)["by_id"]).alias("id", "f")).select("id", "f.*").orderBy("name", "id")


def to_sync(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed files (id, name, modified) that the manifest doesn't have in this version."""
    return listed.join(manifest.select("id", "name", "modified"), ["id", "name", "modified"], "left_anti")


def next_manifest(manifest: DataFrame, synced: DataFrame) -> DataFrame:
    return store.upsert_latest(manifest, synced, ["id"], "time_synced")


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def with_results(raw: DataFrame, results: DataFrame, row_id: str = "row_id") -> DataFrame:
    """raw with the results of its rows; a WO_Number without any value is dropped."""
    out = raw.join(results, row_id, "left")
    if first_existing(out, ["WO_Number"]) and out.agg(F.count_if(F.btrim(F.coalesce("WO_Number", F.lit(""))) != "")).head()[0] == 0:
        out = out.drop("WO_Number")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def bundle(files: dict[str, bytes]) -> bytes:
    """A zip of finished outputs."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(files.items()):
            z.writestr(name, data)
    return out.getvalue()
