"""Workbooks as tables of strings, with the standard library's zip and XML readers.

Files come through Spark's binaryFile source, so that any store it reads will do; a workbook is parsed in one
task, and many workbooks in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MAX_SHEET_ROWS = 1_048_576


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _name(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def sheets(data: bytes) -> dict[str, list[list[str | None]]]:
    """Rows of every sheet, cells as text; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = targets[s.get(_REL)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{{{_NS['m']}}}row"):
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    kind, v = c.get("t"), c.find("m:v", _NS)
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    else:
                        value = v.text if v is not None else None
                        if kind == "s" and value is not None:
                            value = shared[int(value)]
                    cells.append(value or None)
                rows.append(cells)
            out[s.get("name")] = rows
        return out


def pick(found: dict[str, list], sheet: str | None) -> list[list[str | None]]:
    return found[sheet] if sheet else next(iter(found.values()), [])


def headers(row: list[str | None]) -> list[str]:
    """Column names of a header row; blanks get their letter, repeats a number."""
    out: list[str] = []
    for i, x in enumerate(row):
        name = (x or "").strip() or f"Unnamed_{_name(i)}"
        n = sum(y == name or y.startswith(f"{name}.") for y in out)
        out.append(f"{name}.{n}" if n else name)
    return out


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows of a sheet (the first if none is named) below its header row, all strings.

    Every file is read by its own header; the columns are those of all headers, in the order of the files' paths.
    """
    files = spark.read.format("binaryFile").load(path)

    def head(batches):
        for b in batches:
            picked = [pick(sheets(x), sheet) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([headers(p[0]) if p else [] for p in picked], pa.list_(pa.string()))], ["path", "names"])

    kinds = files.select("path", "content").mapInArrow(head, "path string, names array<string>").groupBy("names").agg(F.min("path").alias("first"))
    # One row for each different header.
    names = list(dict.fromkeys(n for r in kinds.orderBy("first").collect() for n in r["names"]))
    if not names:
        return spark.createDataFrame([], "value string")

    def body(batches):
        for b in batches:
            for x in b.column("content").to_pylist():
                rows = pick(sheets(x), sheet)
                at = {n: i for i, n in enumerate(headers(rows[0]))} if rows else {}
                rows = [r for r in rows[1:] if any(v is not None for v in r)]
                columns = [[r[at[n]] if n in at and at[n] < len(r) else None for r in rows] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)

    return files.select("content").mapInArrow(body, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells of every row of every sheet: for sheets without a header."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])
        for b in batches:
            for p, x in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(p, s, i, r) for s, rs in sheets(x).items() for i, r in enumerate(rs)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet string, row long, cells array<string>")


def workbook(names: list[str], rows, sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet with inline strings."""

    def line(i: int, values) -> str:
        cells = "".join(f'<c r="{_name(k)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for k, v in enumerate(values) if v is not None)
        return f'<row r="{i}">{cells}</row>'

    body = "".join(line(i, r) for i, r in enumerate([names, *rows], 1))
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _NS["m"], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """One workbook of df, which must fit a sheet; larger tables raise before anything is written."""
    spark = df.sparkSession
    rows = df.select([F.col(f"`{c}`").cast("string") for c in df.columns]).limit(MAX_SHEET_ROWS).collect()
    if len(rows) >= MAX_SHEET_ROWS:
        raise ValueError("more rows than a sheet holds; write Parquet or CSV")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(jvm_path, True)
    try:
        stream.write(bytearray(workbook(df.columns, rows, sheet)))
    finally:
        stream.close()
