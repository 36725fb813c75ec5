"""Manual citations in free text.

A citation is struct(priority, normalized, manual, ata04, task, raw, source, ord). Three forms are found: with a
manual's name, a bare task number with dashes, and six to eight digits in a row. The best has the lowest
priority number, then the smallest normalized form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes
from . import lexicons as L
from .text import let, on_distinct

# The three forms of citations.
_SEQ = r"(?:\d{2}[- ]?\d{2}(?:[- ]?\d{2,3}){0,3}|\d{6,8})"
PREFIXED = rf"(?iU)\b(TSM|IPC|AMM|FIM|CMM|WDM|SRM)\s*[-:]?\s*({_SEQ})\b"
COMPONENT = rf"(?iU)\bCMM\s*[-:]?\s*{_SEQ}\b"
TASK = r"(?i)(?<![A-Z\d])(\d{2}-\d{2}(?:-\d{2,3}){0,3})(?![A-Z\d])"
COMPACT = r"(?<!\d)(\d{6,8})(?!\d)"


def priority(manual: Column) -> Column:
    out = None
    for name, p in L.MANUAL_PRIORITY.items():
        out = F.when(manual == name, p) if out is None else out.when(manual == name, p)
    return out.otherwise(L.OTHER_PRIORITY)


def _citation(manual: Column, raw: Column, seq: Column, source: str, compat: bool) -> Column:
    def parts(norm: Column) -> Column:
        return F.struct(
            priority(manual).alias("priority"),
            norm.alias("normalized"),
            manual.alias("manual"),
            codes.of_sequence(norm).alias("ata04"),
            F.regexp_replace(norm, r"^\d{2}-\d{2}-?", "").alias("task"),
            raw.alias("raw"),
            F.lit(source).alias("source"),
        )

    return let(codes.sequence(seq, compat), parts)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extract(text: Column, exclude_component: bool = True, compat: bool = False) -> Column:
    """All citations, best first, one for each normalized form.

    exclude_component: component manuals don't count, nor do their digits in another form; with compat the
    digits after a component manual are found again as a bare task.
    """
    return let(F.coalesce(text, F.lit("")), lambda t: _extract(t, exclude_component, compat))


def _extract(t: Column, exclude_component: bool, compat: bool) -> Column:
    rest = F.regexp_replace(t, COMPONENT, " ") if exclude_component and not compat else t
    found = _all(t, PREFIXED, 0)
    named = F.transform(found, lambda raw: let(F.upper(F.regexp_extract(raw, PREFIXED, 1)), lambda m: _citation(m, raw, F.regexp_extract(raw, PREFIXED, 2), "prefix", compat)))
    tasks = F.transform(_all(rest, TASK, 1), lambda raw: _citation(F.lit("UNKNOWN"), raw, raw, "task", compat))
    compact = F.transform(
        F.filter(_all(rest, COMPACT, 1), lambda x: ~((F.length(x) == 8) & x.rlike("^(19|20)"))),
        lambda raw: _citation(F.lit("UNKNOWN"), raw, raw, "compact", compat),
    )
    if exclude_component:
        named = F.filter(named, lambda x: x["manual"] != "CMM")

    def first_of_each(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: ~F.exists(F.slice(ordered, 1, i), lambda y: y["normalized"] == x["normalized"]))

    return let(F.array_sort(F.concat(named, tasks, compact)), first_of_each)


def best(text: Column, exclude_component: bool = True, compat: bool = False) -> Column:
    """The best citation that names a code, else null."""
    return F.get(F.filter(extract(text, exclude_component, compat), lambda x: x["ata04"].isNotNull()), F.lit(0))


def with_citations(df, *texts: str, exclude_component: bool = True, compat: bool = False):
    """df with `citations` of its texts together, best first; distinct texts are read once."""
    return on_distinct(df, list(texts), lambda d: d.withColumn("citations", extract(F.concat_ws("\n", *texts), exclude_component, compat)))


def legacy(text: Column) -> Column:
    """Citations with component manuals kept, five fields."""
    return F.transform(extract(text, exclude_component=False), lambda x: F.struct(x["manual"], x["raw"], x["normalized"], x["ata04"], x["task"]))


def hinted(*texts: Column) -> Column:
    """Whether a text names a manual at all; a cheap test before extraction."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit("")).rlike(r"(?iU)\b(?:AMM|TSM|FIM|ESPM)\b") for t in texts])
