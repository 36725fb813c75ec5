"""Licence scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text is lower-cased in A-Z, cut into words and joined by single spaces; every rule is a regex over that form.
Rules come from hand-written licence families and phrasing patterns below, some hundreds in all. A rule runs
only if its keyword occurs in the text. Of the detections, one that lies within the interval of a detection of
higher priority, or of equal priority and greater length, is suppressed.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are judged alike;
an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Every byte that isn't part of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` becomes a space.
_SPACES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Base phrases and their labels, fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Signature:
    label: str
    regex: str
    keyword: str
    priority: int
    score: float


#: Licence families: label, names as words, versions as words.
FAMILIES = (
    ("agpl", ("gnu affero general public license", "affero general public license", "affero gpl", "agpl"), ("3", "3 0", "1")),
    ("lgpl", ("gnu lesser general public license", "lesser general public license", "gnu library general public license", "lgpl"), ("2", "2 0", "2 1", "3", "3 0")),
    ("gpl", ("gnu general public license", "general public license", "gnu gpl", "gpl"), ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("fdl", ("gnu free documentation license", "free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache software license", "apache license", "apache licence"), ("1 0", "1 1", "2", "2 0")),
    ("mit", ("mit license", "mit licence", "expat license", "mit x11 license"), ()),
    ("bsd", ("bsd license", "bsd licence", "new bsd license", "simplified bsd license", "modified bsd license", "revised bsd license", "berkeley software distribution license"), ("2 clause", "3 clause", "4 clause")),
    ("mpl", ("mozilla public license", "mozilla public licence", "mpl"), ("1 0", "1 1", "2", "2 0")),
    ("epl", ("eclipse public license", "eclipse public licence"), ("1", "1 0", "2", "2 0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public license",), ("1 0",)),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1 0", "1 1", "1 2")),
    ("artistic", ("artistic license", "artistic licence", "perl artistic license"), ("1 0", "2", "2 0")),
    ("boost", ("boost software license", "boost license"), ("1 0",)),
    ("isc", ("isc license", "isc licence"), ()),
    ("zlib", ("zlib license", "zlib libpng license"), ()),
    ("unlicense", ("unlicense license", "the unlicense"), ()),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ("1", "2")),
    ("psf", ("python software foundation license", "psf license"), ("1", "2")),
    ("php", ("php license",), ("3 0", "3 01")),
    ("openssl", ("openssl license",), ()),
    ("ofl", ("sil open font license", "open font license"), ("1 0", "1 1")),
    ("odbl", ("open database license", "odbl"), ("1 0",)),
    ("odc-by", ("open data commons attribution license",), ("1 0",)),
    ("ogl", ("open government licence", "open government license"), ("1 0", "2 0", "3 0")),
    ("ms-pl", ("microsoft public license",), ()),
    ("ms-rl", ("microsoft reciprocal license",), ()),
    ("cecill", ("cecill license", "cecill"), ("1 0", "2 0", "2 1")),
    ("afl", ("academic free license",), ("1 1", "2 0", "2 1", "3 0")),
    ("osl", ("open software license",), ("1 0", "2 0", "2 1", "3 0")),
    ("upl", ("universal permissive license",), ("1 0",)),
    ("busl", ("business source license", "busl"), ("1 1",)),
    ("sspl", ("server side public license", "sspl"), ("1",)),
    ("elastic", ("elastic license",), ("1", "2 0")),
    ("rail", ("openrail license", "creativeml open rail m", "responsible ai license"), ()),
    ("llama", ("llama community license", "llama community license agreement"), ("2", "3", "3 1")),
)
#: Creative Commons: suffix, long name.
CC_KINDS = (
    ("by-nc-nd", "attribution noncommercial noderivatives", "attribution non commercial no derivatives", "by nc nd"),
    ("by-nc-sa", "attribution noncommercial sharealike", "attribution non commercial share alike", "by nc sa"),
    ("by-nc", "attribution noncommercial", "attribution non commercial", "by nc"),
    ("by-nd", "attribution noderivatives", "attribution no derivatives", "by nd"),
    ("by-sa", "attribution sharealike", "attribution share alike", "by sa"),
    ("by", "attribution", "attribution only", "by"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Passages that name no licence by itself: label, regex, keyword, score.
PASSAGES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use", 0.9),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution and use", 1.0),
    ("bsd", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote", "to endorse or promote", 0.9),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", "in no event will the authors", 0.9),
    ("apache", r"you may not use this file except in compliance with the license", "except in compliance", 0.9),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "is free software", 0.8),
    ("gpl", r"copyleft", "copyleft", 0.4),
    ("mpl", r"this source code form is subject to the terms", "source code form", 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered software", 1.0),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "public domain", 0.8),
    ("public-domain", r"(?:is|are) in the public domain", "public domain", 0.6),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0", 0.9),
    ("cc0", r"creative commons zero", "creative commons zero", 0.9),
    ("reserved", r"all rights reserved", "rights reserved", 0.5),
    ("reserved", r"alle rechte vorbehalten", "rechte vorbehalten", 0.5),
    ("reserved", r"tous droits réservés", "tous droits", 0.5),
    ("reserved", r"todos los derechos reservados", "derechos reservados", 0.5),
    ("reserved", r"no part of this (?:work|publication|book|document) may be reproduced", "no part of this", 0.7),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 0.7),
    ("proprietary", r"(?:unauthorized|unauthorised) (?:copying|use|reproduction|distribution)(?: \S+){0,6} (?:is )?(?:strictly )?prohibited", "prohibited", 0.7),
    ("proprietary", r"for (?:internal|evaluation) use only", "use only", 0.5),
    ("noncommercial", r"(?:for )?non ?commercial (?:use|purposes) only", "commercial", 0.6),
)
#: How texts name a licence: regex around {name}, score, rank above the bare name.
PHRASINGS = (
    (r"(?:this work is |is |are )?(?:dual )?(?:re)?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{name}", 1.0, 2),
    (r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?{name}", 1.0, 2),
    (r"(?:subject|according) to (?:the )?(?:terms of (?:the )?)?{name}", 0.9, 1),
    (r"spdx license identifier {name}", 1.0, 3),
    (r"{name}", 0.7, 0),
)


@lru_cache(1)
def signatures() -> tuple[Signature, ...]:
    """All rules, highest priority first: versioned phrasings, phrasings, bare names, passages."""
    rules = []

    def add(label: str, name: str, keyword: str, level: int) -> None:
        for text, score, rank in PHRASINGS:
            rules.append(Signature(label, text.replace("{name}", name), keyword, 10 * level + rank, score))

    for label, names, versions in FAMILIES:
        for name in names:
            add(label, name, name, 1)
            for v in versions:
                add(f"{label}-{v.replace(' ', '.')}", rf"{name} (?:version |v |v)?{v}", name, 2)
    for label, *names in CC_KINDS:
        for name in (f"cc {names[-1]}", *(f"creative commons {x}" for x in names[:-1])):
            keyword = " ".join(name.split()[:2])
            add(f"cc-{label}", name, keyword, 1 + len(label) // 3)
            for v in CC_VERSIONS:
                add(f"cc-{label}-{v.replace(' ', '.')}", rf"{name}(?: international| unported)?(?: license)? {v}", keyword, 5 + len(label) // 3)
    rules += [Signature(label, regex, keyword, 15 if score >= 0.9 else 5, score) for label, regex, keyword, score in PASSAGES]
    return tuple(sorted(rules, key=lambda r: (-r.priority, r.label, r.regex)))


def words_of(text: str | None) -> bytes:
    """Words between single spaces, one space at either end; a text without words gives one space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()
    return b" " + b" ".join(words) + b" " if words else b" "


@lru_cache(1)
def _compiled() -> tuple[tuple[bytes, tuple[tuple[re.Pattern, Signature], ...]], ...]:
    by: dict[str, list] = {}
    for r in signatures():
        by.setdefault(r.keyword, []).append((re.compile(rb" (?:" + r.regex.encode() + rb")(?= )"), r))
    return tuple((k.encode(), tuple(v)) for k, v in sorted(by.items()))


def detect(norm: bytes) -> list[tuple[int, int, Signature]]:
    """Detections (start, end, rule) that stand after suppression; offsets are bytes of the normalized text."""
    found = [(m.start(), m.end(), r) for keyword, rules in _compiled() if keyword in norm for p, r in rules for m in p.finditer(norm)]
    found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
    return _unsuppressed(found)


def _unsuppressed(found: list) -> list:
    """Keep, in order of priority and length, what no kept detection contains.

    `starts` and `ends` hold the kept intervals that lie in no other one; both ascend, so that the interval
    that starts last before a detection reaches farthest, and one bisection decides.
    """
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for a, b, r in found:
        i = bisect_right(starts, a)
        if i and ends[i - 1] >= b:
            continue
        j = i
        while j < len(starts) and ends[j] <= b:
            j += 1
        if i and starts[i - 1] == a:
            i -= 1
        starts[i:j], ends[i:j] = [a], [b]
        kept.append((a, b, r))
    return kept


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of one text."""
    norm = words_of(text)
    n_words = norm.count(b" ") - 1
    places, base = [], set()
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at = norm.find(needle)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = norm.find(needle, at + 1)
    first, last = (norm.count(b" ", 0, min(places)), norm.count(b" ", 0, max(places))) if places else (None, None)
    found = detect(norm)
    labels = base | {r.label for _, _, r in found}
    score = max([r.score for _, _, r in found], default=0.5 if base else 0.0)
    spans = [{"label": r.label, "first_word": norm.count(b" ", 0, a), "n_words": norm.count(b" ", a, b), "score": r.score} for a, b, r in sorted(found, key=lambda x: x[:2])]
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])
_FIELDS = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(_SPAN)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id with the scan of its whole text; `detections` lists label, place in words and score."""

    def run(batches):
        for b in slices(batches, "text"):
            rows = list(zip(*[scan(t) for t in b.column("text").to_pylist()], strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(v, k) for v, (_, k) in zip(rows, _FIELDS, strict=True)]], ["doc_id", *[n for n, _ in _FIELDS]])

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "detections array<struct<label:string,first_word:long,n_words:long,score:double>>",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
