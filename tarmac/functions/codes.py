"""ATA codes: parsing and normal forms as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def ata04(c: Column, strict: bool = False) -> Column:
    """The first four digits anywhere as AA-BB, null if there are fewer.

    strict: only text that consists of a code, and not 00-00 or 99-99.
    """
    digits = F.regexp_replace(c, r"\D", "")
    code = F.when(F.length(digits) >= 4, F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2)))
    if strict:
        return F.when(c.rlike(r"^\s*\d{2}[-\s]?\d{2}(?:[-\s]?\d{2,3})*\s*$") & ~code.isin("00-00", "99-99"), code)
    return code


def _level(c: Column, pairs: int) -> Column:
    pattern = r"(?<!\d)" + r"[- ]?".join([r"(\d{2})"] * pairs) + r"(?!\d)"
    parts = [F.regexp_extract(c, pattern, i + 1) for i in range(pairs)]
    return F.when(c.rlike(pattern), F.concat_ws("-", *parts))


def ata2(c: Column) -> Column:
    return _level(c, 1)


def ata4(c: Column) -> Column:
    return _level(c, 2)


def ata6(c: Column) -> Column:
    return _level(c, 3)


def parse_level(c: Column) -> Column:
    """struct(code, description, level) of `code - description`, trying 8, 6, 4, then 2 digits; null if none fits."""
    out = None
    for n in (4, 3, 2, 1):
        pattern = r"^\s*(" + "-".join([r"\d{2}"] * n) + r")\s*-\s*(.+?)\s*$"
        value = F.struct(F.regexp_extract(c, pattern, 1).alias("code"), F.regexp_extract(c, pattern, 2).alias("description"), F.lit(2 * n).alias("level"))
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    return out


def first_two(c: Column) -> Column:
    """The first two dash parts of a code, the code itself if it has fewer."""
    parts = F.split(c, "-")
    return F.when(F.size(parts) >= 2, F.concat_ws("-", parts[0], parts[1])).otherwise(c)


def sequence(c: Column, compat: bool = False) -> Column:
    """Digits of a citation as AA-BB-..., fewer than four digits unchanged.

    Groups already written stay; a run is cut into pairs, with three digits in the last group where the length is
    odd. compat: the rest is cut into threes first, then twos, whatever was written.
    """
    return let(F.regexp_replace(c, r"\D", ""), lambda digits: _sequence(c, digits, compat))


def _sequence(c: Column, digits: Column, compat: bool) -> Column:
    rest = F.substring(digits, 5, 64)
    head = (F.substring(digits, 1, 2), F.substring(digits, 3, 2))
    if compat:
        chunks = F.regexp_extract_all(rest, F.lit(r"(\d{3}|\d{2}|\d)"), F.lit(1))
        return F.when(F.length(digits) < 4, c).otherwise(F.concat_ws("-", *head, chunks))
    odd = F.length(rest) % 2 == 1
    chunks = F.regexp_extract_all(rest, F.lit(r"(\d{3}(?=$)|\d{2}(?=\d)|\d)"), F.lit(1))
    pairs = F.regexp_extract_all(rest, F.lit(r"(\d{2})"), F.lit(1))
    whole = F.concat_ws("-", *head, F.when(odd, chunks).otherwise(pairs))

    def as_written(written: Column) -> Column:
        return F.when(written.rlike(r"^\d{2}-\d{2}(?:-\d{2,3})*$"), written).otherwise(whole)

    return F.when(F.length(digits) < 4, c).otherwise(let(F.regexp_replace(F.regexp_replace(c, r"[\s-]+", "-"), r"^-|-$", ""), as_written))


def of_sequence(c: Column) -> Column:
    """AA-BB of a normalized sequence."""
    return F.when(c.rlike(r"^\d{2}-\d{2}"), F.substring(c, 1, 5)).otherwise(first_two(c))


def catalog_code(c: Column) -> Column:
    """A catalog's code as AA-BB: other characters dropped, a missing dash put in; null if too short."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9-]", "")
    digits = F.regexp_replace(bare, "-", "")
    code = F.when(bare.rlike(r"^\d{2}-\d{2}"), F.substring(bare, 1, 5)).when(F.length(digits) >= 4, F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2)))
    return F.when(F.length(code) >= 5, code)
