"""Whether a work order reports a technical defect: weighted pattern families, or keyword lists.

Work orders repeat their texts, and a text costs hundreds of times more to classify than to shuffle: distinct texts are
classified, and the results joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from .text import nfkc_of, on_distinct, squeeze, strip


def _joined(desc: Column, action: Column, compat: bool) -> Column:
    if compat:  # a missing cell reads as the word nan, and lines are joined before they are filtered
        desc, action = F.coalesce(desc, F.lit("nan")), F.coalesce(action, F.lit("nan"))
        return strip(F.concat_ws(" ", squeeze(desc), squeeze(action)))
    return strip(F.concat_ws("\n", F.coalesce(desc, F.lit("")), F.coalesce(action, F.lit(""))))


def without_meta(text: Column) -> Column:
    """Text without notes in parentheses and without lines of paperwork, unless a line has a warning or symptom."""
    lines = F.split(F.regexp_replace(text, L.FLAGS + L.PAREN_META, " "), r"[\r\n]+")
    telling = L.any_of([*L.FAMILIES["warn_ctx"], *L.FAMILIES["strong_symptom"]])
    kept = F.filter(lines, lambda x: ~x.rlike(L.bare(L.META_LINES)) | x.rlike(telling))
    return squeeze(F.array_join(kept, " "))


def hit_counts(text: Column, ascii_only: bool = False) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(L.family(name, ascii_only))) for name in L.FAMILIES}


def with_scores(df: DataFrame, desc: str, action: str, wo_type: str | None = None, compat: bool = False) -> DataFrame:
    """df with `_text` in NFKC, a count for each family (`h_...`), defect_score, nondef_score and scheduled."""
    typed = squeeze(nfkc_of(F.col(wo_type))) if wo_type else F.lit("")
    t = F.col("_text")
    one = df.withColumn("_text", nfkc_of(_joined(F.col(desc), F.col(action), compat))).withColumn("_text", without_meta(t))
    one = one.select("*", *[c.alias(f"h_{k}") for k, c in hit_counts(t).items()], typed.rlike(L.any_of(L.SCHEDULED_TYPE)).alias("scheduled"))
    boosted = F.col("h_defect_with_context") + (t.rlike(L.FLAGS + L.NRC_FINDING) & t.rlike(L.any_of(L.NRC_SUPPORT))).cast("int")
    damped = F.when((F.col("h_instructional") > 0) & (boosted > 0), boosted - 1).otherwise(boosted)
    planned = (F.col("scheduled") & ((F.col("h_routine_generic") > 0) | (F.col("h_scheduled_overhaul") > 0))).cast("int")
    two = one.withColumns({"h_defect_with_context": damped, "h_scheduled_routine": planned})

    def total(weights: dict[str, float]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"h_{k}") * F.lit(w) for k, w in weights.items()])

    return two.withColumns({"defect_score": total(L.DEFECT_WEIGHTS), "nondef_score": total(L.NONDEFECT_WEIGHTS)})


def rule() -> Column:
    """Name of the first rule that decides, over the columns of with_scores. Those in DEFECT_RULES mean a defect."""
    h = {k: F.col(f"h_{k}") for k in (*L.FAMILIES, "scheduled_routine")}
    sched, t = F.col("scheduled"), F.col("_text")
    upkeep = sched | (h["routine_generic"] > 0) | (h["rigging_servicing"] > 0)
    strong, fixed, clear = h["strong_symptom"] > 0, h["corrective_strong"] > 0, h["no_finding"] > 0
    lead = F.col("defect_score") - F.col("nondef_score")
    planned = sched & ((h["routine_generic"] > 0) | (h["scheduled_overhaul"] > 0) | (h["rigging_servicing"] > 0))
    return (
        F.when(t == "", "empty")
        .when(upkeep & clear & ~strong & ~fixed, "scheduled_no_finding")
        .when(t.rlike(L.FLAGS + L.NRC_RAISED) & t.rlike(L.FLAGS + L.NRC_NIL), "nrc_nil")
        .when(strong & clear & upkeep, "symptom_but_no_finding")
        .when(strong, "strong_symptom")
        .when(fixed, "corrective_strong")
        .when(planned & (h["defect_with_context"] == 0), "scheduled_routine")
        .when(lead <= -L.DECISION_MARGIN, "score_nondefect")
        .when(lead >= L.DECISION_MARGIN, "score_defect")
        .when(sched & clear & ((h["routine_generic"] > 0) | (h["rigging_servicing"] > 0)), "tie_no_finding")
        .otherwise("safety_first")
    )


DEFECT_RULES = ("strong_symptom", "corrective_strong", "score_defect", "safety_first")


def classified(df: DataFrame, desc: str, action: str, wo_type: str | None, compat: bool = False) -> DataFrame:
    """classify of each row of df by itself, for tables of distinct texts."""
    scored = with_scores(df, desc, action, wo_type, compat).withColumn("rule", rule())
    hits = F.struct(*[F.col(f"h_{k}").alias(k) for k in (*L.FAMILIES, "scheduled_routine")]).alias("hits")
    return scored.select(*df.columns, F.col("rule").isin(*DEFECT_RULES).alias("is_technical"), "rule", "defect_score", "nondef_score", hits)


def classify(df: DataFrame, desc: str = "defect", action: str = "action", wo_type: str | None = None, compat: bool = False) -> DataFrame:
    """df with is_technical, rule, defect_score, nondef_score and the hits of each family."""
    return on_distinct(df, [c for c in (desc, action, wo_type) if c], lambda d: classified(d, desc, action, wo_type, compat))


def matched(text: Column, keywords) -> Column:
    """The keyword patterns that a text holds, in the list's order."""
    checks = F.array(*[F.struct(F.lit(k).alias("k"), text.rlike(L.FLAGS + k).alias("hit")) for k in keywords])
    return F.transform(F.filter(checks, lambda x: x["hit"]), lambda x: x["k"])


def classify_keywords(df: DataFrame, desc: str, action: str, wo_type: str, routine=L.ROUTINE_KEYWORDS, defect=L.DEFECT_KEYWORDS, inspection=L.INSPECTION_KEYWORDS) -> DataFrame:
    """df with is_technical_defect, confidence, reason and matched_patterns (at most three) by keyword lists."""
    return on_distinct(df, [desc, action, wo_type], lambda d: _by_keywords(d, desc, action, wo_type, routine, defect, inspection))


def _by_keywords(df: DataFrame, desc: str, action: str, wo_type: str, routine, defect, inspection) -> DataFrame:
    t = F.concat_ws(" ", F.coalesce(F.col(desc), F.lit("")), F.coalesce(F.col(action), F.lit("")))
    kind = F.upper(F.coalesce(F.col(wo_type), F.lit("")))
    sched = kind.contains("SCHEDULED") & ~kind.contains("UNSCHEDULED")
    found = df.withColumns({"_r": matched(t, routine), "_d": matched(t, defect), "_i": matched(t, inspection), "_s": sched})
    r, d, i = F.size("_r") > 0, F.size("_d") > 0, F.size("_i") > 0

    def verdict(is_defect: bool, confidence: float, reason: str, keys: str | None) -> Column:
        names = F.col(keys) if keys else F.array().cast("array<string>")
        return F.struct(F.lit(is_defect).alias("d"), F.lit(confidence).alias("c"), F.lit(reason).alias("why"), names.alias("m"))

    v = (
        F.when(F.col("_s") & r, verdict(False, 0.9, "scheduled routine", "_r"))
        .when(F.col("_s") & i & d, verdict(True, 0.95, "scheduled with finding", "_d"))
        .when(F.col("_s") & d, verdict(True, 0.7, "scheduled with defect", "_d"))
        .when(F.col("_s"), verdict(False, 0.8, "scheduled", None))
        .when(r, verdict(False, 0.9, "routine", "_r"))
        .when(d, verdict(True, 0.9, "defect", "_d"))
        .otherwise(verdict(False, 0.6, "no keyword", None))
    )
    out = found.withColumn("_v", v)
    return out.select(*df.columns, F.col("_v.d").alias("is_technical_defect"), F.col("_v.c").alias("confidence"), F.col("_v.why").alias("reason"), F.slice("_v.m", 1, 3).alias("matched_patterns"))
