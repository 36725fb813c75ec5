"""Text cleaning as Column functions.

Null text counts as empty unless said otherwise. All patterns are literals, compiled once for a task.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicons as L


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim Unicode white space; SQL's trim takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return strip(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def normalize_case(c: Column) -> Column:
    """Lower case, single spaces."""
    return F.lower(squeeze(c))


def manual_references(c: Column, groups: int = 8) -> Column:
    """`AMM 21 51 00` and the like become `AMM 21-51-00`: upper-case manual, digit groups joined by dashes.

    One pass puts a mark before each reference's digits, then a group is joined per pass, up to `groups`.
    """
    names = "|".join(L.MANUALS)
    out = _text(c)
    for m in L.MANUALS:
        out = F.regexp_replace(out, rf"(?iU)\b{m}\s*[-:]?\s*(\d+(?:[-\s]+\d+|\d)+)\b", f"{m} $1")
    joined = rf"(?U)(\b(?:{names}) \d+(?:-\d+)*)(?:\s+-?\s*|-\s*-?\s*(?<=[\s-]{{2}}))(\d+)\b"
    for _ in range(groups):
        out = F.regexp_replace(out, joined, "$1-$2")
    return out


def system_messages(c: Column) -> Column:
    """`ECAM FAULT` becomes `ECAM-FAULT`."""
    out = _text(c)
    for pattern, replacement in L.SYSTEM_MESSAGES:
        out = F.regexp_replace(out, L.FLAGS + pattern, replacement)
    return out


def keeps(c: Column) -> Column:
    """Whether a line holds a technical term."""
    return c.rlike(L.FLAGS + rf"\b(?:{'|'.join(L.KEEP_TERMS)})\b")


def clean(c: Column) -> Column:
    """Canonical references and messages, without lines of paperwork, in one line."""
    lines = F.split(system_messages(manual_references(c)), r"[\r\n]+")
    kept = F.filter(lines, lambda x: (strip(x) != "") & (~x.rlike(L.bare(L.CLEAN_META)) | keeps(x)))
    return squeeze(F.array_join(F.transform(kept, strip), " "))


def technical_keywords(c: Column) -> Column:
    """Sorted distinct manuals cited, system messages (upper case) and ATA codes as written."""
    c = _text(c)
    manuals = F.regexp_extract_all(c, F.lit(L.FLAGS + rf"\b({'|'.join(L.MANUALS)})\s+[\d-]+\b"), F.lit(1))
    pattern = L.FLAGS + r"\b(?:ECAM|EICAS|CAS|BITE|FWC)[-\s](?:FAULT|FAIL|WARN|TEST)\b"
    messages = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.upper(F.regexp_replace(x, r"(?U)\s", "-")))
    codes = F.regexp_extract_all(c, F.lit(L.FLAGS + r"\bATA\s*\d{2}[-\s]?\d{2}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(manuals, messages, codes)))


def split_defect_action(c: Column) -> Column:
    """struct(defect, action): cut at the first separator that occurs, in order of the list; else no action."""
    c = _text(c)
    out = None
    for sep in L.SEPARATORS:
        parts = F.split(c, L.FLAGS + sep, 2)
        value = F.struct(strip(parts[0]).alias("defect"), strip(parts[1]).alias("action"))
        out = F.when(c.rlike(L.FLAGS + sep), value) if out is None else out.when(c.rlike(L.FLAGS + sep), value)
    return out.otherwise(F.struct(strip(c).alias("defect"), F.lit("").alias("action")))


def comparable(c: Column) -> Column:
    """Cleaned lower-case text of word characters, spaces and dashes."""
    return squeeze(F.regexp_replace(F.lower(clean(c)), r"(?U)[^\w\s-]", ""))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(comparable(c), " "), ""))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets; 0 if either is empty."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def compose(defect: Column, action: Column) -> Column:
    """Cleaned defect and action joined by ` | `, blanks left out."""
    return F.concat_ws(" | ", F.nullif(clean(defect), F.lit("")), F.nullif(clean(action), F.lit("")))


def text_hash(c: Column) -> Column:
    """SHA-1 of the text, in hex."""
    return F.sha1(_text(c))


def pair_hash(defect: Column, action: Column) -> Column:
    return F.sha1(F.concat_ws("||", _text(defect), _text(action)))


def clipped(c: Column, n: int) -> Column:
    return F.substring(strip(_text(c)), 1, n)


def clean_map_text(c: Column) -> Column:
    """A cell of the code map without the screen's leading icons; no-break spaces become spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(_text(c), " ", " "), r"(?iU)^\s*(?:expand_more|chevron_right|xpand_more)\s*", ""))


def is_code_line(c: Column) -> Column:
    return clean_map_text(c).rlike(r"^\d{2}")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc_of(c: Column) -> Column:
    """The column in NFKC. All rows pass through Python: for tables of distinct texts."""
    return _nfkc(c)


def nfkc(df, column: str):
    """df with the column in NFKC. Only rows with other than ASCII characters pass through Python."""
    ascii_only = F.col(column).isNull() | ~F.col(column).rlike(r"[^\x00-\x7F]")
    plain = df.where(ascii_only)
    return plain.unionByName(df.where(~ascii_only).withColumn(column, _nfkc(F.col(column))))


def on_distinct(df, columns: list[str], make):
    """df with the columns that make(distinct rows of `columns`) adds, joined back; missing values are equal.

    Partial aggregates collapse repeated rows before the shuffle, and Spark broadcasts the distinct ones if they are few.
    """
    found = make(df.select(*columns).distinct())
    added = [c for c in found.columns if c not in columns]
    keys = [f"_key{i}" for i in range(len(columns))]
    found = found.select(*[F.col(c).alias(k) for c, k in zip(columns, keys, strict=True)], *added)
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{k}")) for c, k in zip(columns, keys, strict=True)])
    return df.alias("l").join(found.alias("r"), same, "left").select("l.*", *[F.col(f"r.{c}") for c in added])


def let(value: Column, body) -> Column:
    """Bind value once inside an expression: body gets it as a lambda variable, so it isn't evaluated again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tagged_record(title: Column, description: Column, ata2: Column, ata4: Column, ata6: Column, engine: Column) -> Column:
    """A record as one text: title, description, then tags of what is known."""
    tags = [F.when(_text(c) != "", F.concat(F.lit(f"[{k}:"), c, F.lit("]"))) for k, c in (("ATA2", ata2), ("ATA4", ata4), ("ATA6", ata6), ("ENG", engine))]
    return F.concat_ws(" ", F.nullif(strip(_text(title)), F.lit("")), F.nullif(strip(_text(description)), F.lit("")), *tags)


def history_record(ata4: Column, *texts: Column) -> Column:
    """A work order as a document: a header line with its code, then the texts that aren't blank."""
    head = F.concat(F.lit("[WO] [ATA4:"), _text(ata4), F.lit("]"))
    return F.concat_ws("\n", head, *[F.when(strip(_text(t)) != "", strip(t)) for t in texts])
