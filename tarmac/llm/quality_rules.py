"""Quality rules as a short-circuit cascade (native: DataFrame functions only).

Features come from whole texts inside one row, without a shuffle. The query's order of the rules, the base ones
included, is chosen on a sample of texts: each rule's own expression is timed on them and its rejections counted, and
rules run by rejections per second. A text is split into words once; every other feature is computed only if no
earlier rule rejects the row. The order changes the work, not the verdict; rates within a factor of two count as
equal and leave the given order, so that it hardly depends on the clock. keep_passing, the pipeline's stage, takes
nothing from a sample: its rules run in the order of the costs that they state.

Defined results: null text counts as empty and fails; null doc_id and repeated rows pass through row by row; texts of
any length count whole; an empty table gives an empty table and the given order; the query reads doc_id and
text only, and keep_passing carries all columns in one struct, so that no name clashes.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Workspace, let, words_of

SYMBOLS = "#*$%&|<>"
#: Texts of fewer than 2 ** PLACE_BITS words pack a window's place with its hash into a long; others use structs.
PLACE_BITS = 26
#: Share of rows that the rule order is estimated on, before the cap of sample_rows.
SAMPLE_SHARE = 0.02


class Packed:
    """A window's hash and place in one long, the place in the low bits."""

    def pack(self, h: Column, place: Column) -> Column:
        return F.shiftleft(h, PLACE_BITS).bitwiseOR(place.cast("long"))

    def place(self, x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def near(self, x: Column, y: Column) -> Column:
        return F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0


class Paired:
    """A window's hash and place as a struct."""

    def pack(self, h: Column, place: Column) -> Column:
        return F.struct(h.alias("h"), place.alias("at"))

    def place(self, x: Column) -> Column:
        return x["at"]

    def near(self, x: Column, y: Column) -> Column:
        return x["h"] == y["h"]


def _repeated_words(words: Column, n: int, form) -> Column:
    def entries(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: form.pack(F.xxhash64(*[F.get(w, i + k) for k in range(n)]), i))

    def twins(s: Column) -> Column:
        """Entries whose hash equals a neighbour's; a null comparison at either end counts as no."""
        return F.filter(s, lambda x, j: form.near(x, F.get(s, j - 1)) | form.near(x, F.get(s, j + 1)))

    def repeated(w: Column, s: Column) -> Column:
        """Places of twins with the same words as another; only where hashes deceive is that one not a neighbour."""

        def same(x: Column, y: Column) -> Column:
            eq = form.place(x) != form.place(y)
            for k in range(n):
                eq = eq & (F.get(w, form.place(x) + k) == F.get(w, form.place(y) + k))
            return F.coalesce(eq, F.lit(False))

        kept = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)) | F.exists(s, lambda y: F.when(form.near(x, y), same(x, y)).otherwise(False)))
        return F.sort_array(F.transform(kept, form.place))

    def covered(p: Column) -> Column:
        zero = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(p, zero, lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(n), x - a["last"])).alias("total")), lambda a: a["total"])

    return let(F.sort_array(entries(words)), lambda s: let(twins(s), lambda t: covered(repeated(words, t))))


def repeat_words(words: Column, n: int = 3) -> Column:
    """Words covered by n-word windows found twice or more in the array, first windows included.

    Windows are hashed, sorted by their hashes, and those with equal hashes compared word by word. Linear space,
    n log n time, all within the row.
    """
    return let(words, lambda w: F.when(F.size(w) < n, F.lit(0).cast("long")).when(F.size(w) < 1 << PLACE_BITS, _repeated_words(w, n, Packed())).otherwise(_repeated_words(w, n, Paired())))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)


class Features:
    """The features that rules speak of: expressions over a text and its words, or columns that hold them already."""

    NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def __init__(self, text: Column | None = None, words: Column | None = None):
        self.text, self.words = text, words

    def __getattr__(self, name: str) -> Column:
        if name not in self.NAMES:
            raise AttributeError(name)
        if self.text is None:
            return F.col(name)
        t, w = self.text, self.words
        found = {
            "n_words": lambda: F.size(w),
            "word_chars": lambda: F.length(F.array_join(w, "")),
            "n_symbols": lambda: F.size(F.split(t, f"[{SYMBOLS}]")) - 1,
            "n_lines": lambda: F.size(_lines(t)),
            "n_dup_lines": lambda: let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": lambda: repeat_words(w),
        }
        return found[name]().cast("long")


@dataclass(frozen=True)
class Rule:
    """A named rejection; `reject` makes a Column from Features, null counts as not rejected.

    cost: the work of its expression beyond the splitting into words, to order rules by where nothing is measured.
    """

    name: str
    reject: Callable[[Features], Column]
    cost: float = 1.0


#: The rules whose rejection is base_failed. Costs of these and the default rules: seconds over 0.1 GB on 6 cores, rounded.
BASE = (Rule("few_words", lambda f: f.n_words < 50, 0), Rule("repeats", lambda f: 100 * f.n_repeat_words > 50 * f.n_words, 11))


def default_rules() -> list[Rule]:
    """The base rules, and rejections that each leave a wide margin around ordinary prose."""
    return [
        *BASE,
        Rule("symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words, 1),
        Rule("dup_lines", lambda f: (f.n_lines >= 4) & (100 * f.n_dup_lines > 50 * f.n_lines), 2),
        Rule("short_words", lambda f: 10 * f.word_chars < 20 * f.n_words, 0.5),
        Rule("long_words", lambda f: f.word_chars > 20 * f.n_words, 0.5),
    ]


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the features of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    f = Features(t, F.col("_w"))
    return docs.withColumn("_w", words_of(t)).select(*docs.columns, *[getattr(f, n).alias(n) for n in Features.NAMES])


def cascade(rules: list[Rule], f: Features) -> Column:
    """Name of the first rule that rejects, in this order; later rules aren't evaluated. Null: none rejects."""
    c = None
    for r in rules:
        hit = F.coalesce(r.reject(f), F.lit(False))
        c = F.when(hit, F.lit(r.name)) if c is None else c.when(hit, F.lit(r.name))
    return F.lit(None).cast("string") if c is None else c


def rejected_by(rules: list[Rule], text: str = "text") -> Column:
    """The cascade over a raw text, which is split into words once."""
    t = F.coalesce(F.col(text), F.lit(""))
    return let(words_of(t), lambda w: cascade(rules, Features(t, w)))


def _seconds(sample: DataFrame, value: Column, times: int = 3) -> tuple[float, int]:
    """The shortest of some runs over the sample, and how many rows the value isn't null for."""
    spent = []
    for _ in range(times):
        began = time.perf_counter()
        n = sample.agg(F.count(value)).head()[0]
        spent.append(time.perf_counter() - began)
    return min(spent), n


def plan_cascade(docs: DataFrame, rules: list[Rule], ws: Workspace, sample_rows: int = 2000) -> list[tuple[Rule, float, float]]:
    """Rules with (seconds, share rejected) on a sample of at most sample_rows texts, most rejections per second first.

    A rule's seconds are those of its own expression over the raw texts, less those of splitting them into words.
    The sample only sets the order; an empty one keeps the given order.
    """
    sample = ws.write(docs.select("text").limit(sample_rows), "sample")
    least, n = _seconds(sample, rejected_by([Rule("split", lambda f: f.n_words < 0)]))[0], sample.count()
    found = []
    for place, r in enumerate(rules):
        spent, hit = _seconds(sample, rejected_by([r])) if n else (0.0, 0)
        spent = max(spent - least, 1e-3)
        rate = math.floor(math.log2(hit / n / spent)) if hit else -math.inf
        found.append((-rate, spent if rate == -math.inf else 0.0, place, r, spent, hit / n if n else 0.0))
    ws.drop(sample)
    return [(r, spent, share) for *_, r, spent, share in sorted(found, key=lambda x: x[:3] if n else x[2:3])]


def _order(docs: DataFrame, rules: list[Rule] | None, sample_rows: int) -> list[Rule]:
    rules = default_rules() if rules is None else rules
    sample = docs.select("text").sample(SAMPLE_SHARE, seed=1)
    return [r for r, _, _ in plan_cascade(sample, rules, Workspace(docs.sparkSession, "quality-rules"), sample_rows)]


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """docs' doc_id and text with all features, base_failed, rejected_by and kept."""
    own = Features()
    base = [F.coalesce(r.reject(own), F.lit(False)) for r in BASE]
    f = with_features(docs.select("doc_id", "text")).withColumn("base_failed", base[0] | base[1])
    return f.withColumn("rejected_by", cascade(_order(docs, rules, sample_rows), own)).withColumn("kept", F.col("rejected_by").isNull() & ~F.col("base_failed"))


def query(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB: windows as rows.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, hash3 FROM (
        SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3) x,
        LATERAL (SELECT x.ws[x.i] || ' ' || x.ws[x.i + 1] || ' ' || x.ws[x.i + 2] AS hash3) y),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, hash3) AS c FROM g) WHERE c >= 2),
c AS (SELECT doc_id, sum(least(3, i - coalesce(p, -10)))::BIGINT AS n FROM (
        SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words
       OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)
       OR 10 * word_chars < 20 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""


def keep_passing(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with the columns of docs; a rejected row costs no more than the rules up to its own.

    Cheap rules come first, by their stated costs: nothing is counted or timed beforehand.
    """
    rules = sorted(default_rules() if rules is None else rules, key=lambda r: r.cost)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return inner.where(rejected_by(rules).isNull()).select("row.*")
