"""Decisions from three pieces of evidence: entered code e0, citation e1, catalog match e2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import CONFIDENCE, CONFLICT


def _verdict(decision: str, confidence: Column, reason: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), confidence.alias("confidence"), F.lit(reason).alias("reason"))


def decide(e0: Column, e1_valid: Column, e1: Column, e2: Column, e2_score: Column, e1_source: Column | None = None) -> Column:
    """struct(decision, confidence, reason): the first case that fits. A missing code differs from any code."""
    source = F.coalesce(e1_source, F.lit("UNKNOWN")) if e1_source is not None else F.lit("UNKNOWN")
    cited = F.coalesce(e1_valid, F.lit(False)) & e1.isNotNull()
    base = F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in CONFLICT.items()], F.lit(CONFLICT["UNKNOWN"]))
    conflict = F.when(F.coalesce(e2_score, F.lit(0.0)) > 0.85, base * 0.95).otherwise(base)
    return (
        F.when(cited & (e1 == e2) & e0.eqNullSafe(e1), _verdict("CONFIRM", F.lit(CONFIDENCE["all"]), "entered, citation and catalog agree"))
        .when(cited & (e1 == e2), _verdict("CORRECT", F.lit(CONFIDENCE["correct"]), "citation and catalog agree on another code"))
        .when((e2 == e0) & ~F.coalesce(e1_valid, F.lit(False)), _verdict("CONFIRM", F.lit(CONFIDENCE["catalog"]), "catalog agrees, no citation"))
        .when(cited & e2.isNull(), _verdict("CONFIRM", F.lit(CONFIDENCE["citation"]), "citation only"))
        .when(cited & e2.isNotNull(), _verdict("REVIEW", conflict, "citation and catalog differ"))
        .when(e0.isNotNull() & e1.isNull() & e2.isNull(), _verdict("REVIEW", F.lit(CONFIDENCE["entered"]), "entered code only"))
        .otherwise(_verdict("REVIEW", F.lit(CONFIDENCE["none"]), "not enough evidence"))
    )


def recommended(decision: Column, e0: Column, e1: Column, e2: Column, e2_score: Column, e1_source: Column) -> Column:
    """The code to use: entered if confirmed, cited or matched if corrected, else by trust in the source."""
    trusted = e1_source.isin("TSM", "IPC") & e1.isNotNull()
    review = F.when(trusted, e1).when(F.coalesce(e2_score, F.lit(0.0)) > 0.8, F.coalesce(e2, e1, e0)).otherwise(F.coalesce(e1, e2, e0))
    return F.when(decision == "CONFIRM", F.coalesce(e0, e1, e2)).when(decision == "CORRECT", F.coalesce(e1, e2)).otherwise(review)


def citation_valid(technical: Column, code: Column) -> Column:
    return technical & (F.length(code) >= 4)


def final_code(e0: Column, e1: Column, e2: Column) -> Column:
    """First code at hand: citation, catalog, entered."""
    return F.coalesce(e1, e2, e0)


def decide_table(df: DataFrame) -> DataFrame:
    """df(e0, e1, e1_valid, e1_source, e2, e2_score) with decision, confidence, reason, recommended, final."""
    v = df.withColumn("_v", decide(*[F.col(c) for c in ("e0", "e1_valid", "e1", "e2", "e2_score", "e1_source")]))
    rec = recommended(F.col("_v.decision"), *[F.col(c) for c in ("e0", "e1", "e2", "e2_score", "e1_source")])
    return v.select(*df.columns, "_v.decision", "_v.confidence", "_v.reason", rec.alias("recommended"), final_code(F.col("e0"), F.col("e1"), F.col("e2")).alias("final"))


def candidates(e0: Column, e1: Column, e2s: Column, most: int = 5) -> Column:
    """array of struct(code, score, source): citation 1.0, catalog scores, entered 0.5; the first of a code counts, best first."""
    kind = "array<struct<code:string,score:double,source:string>>"
    one = lambda c, s, n: F.when(c.isNotNull(), F.array(F.struct(c.alias("code"), F.lit(s).alias("score"), F.lit(n).alias("source")))).otherwise(F.array()).cast(kind)
    catalog = F.transform(F.coalesce(e2s, F.array().cast("array<struct<ata04:string,score:double>>")), lambda x: F.struct(x["ata04"].alias("code"), x["score"].cast("double").alias("score"), F.lit("catalog").alias("source")))
    every = F.concat(one(e1, 1.0, "citation"), catalog, one(e0, 0.5, "entered"))
    first = F.aggregate(every, F.array().cast(kind), lambda seen, x: F.when(F.exists(seen, lambda y: F.upper(y["code"]) == F.upper(x["code"])), seen).otherwise(F.array_append(seen, x)))
    ranked = F.array_sort(F.transform(first, lambda x: F.struct((-x["score"]).alias("k"), x["code"].alias("code"), x["score"].alias("score"), x["source"].alias("source"))))
    return F.slice(F.transform(ranked, lambda x: F.struct(x["code"], x["score"], x["source"])), 1, most)


def for_arbitration(df: DataFrame, order: str, below: float = 0.82, quota: int = 300) -> DataFrame:
    """Technical rows under review, of low confidence or without a code: the first `quota` by order."""
    unclear = (F.col("decision") == "REVIEW") | (F.col("confidence") < below) | F.col("final").isNull()
    return df.where(F.col("technical") & unclear).orderBy(order).limit(quota)


def first_candidate(batches):
    """The offline arbiter: the best candidate, as a mapInPandas function over (row_id, candidates)."""
    for pdf in batches:
        pdf["choice"] = [c[0]["code"] if c is not None and len(c) else None for c in pdf["candidates"]]
        yield pdf[["row_id", "choice"]]


def arbitrate(df: DataFrame, arbiter=first_candidate) -> DataFrame:
    """row_id, choice: what the arbiter, any mapInPandas function, makes of df(row_id, candidates)."""
    return df.select("row_id", "candidates").mapInPandas(arbiter, "row_id string, choice string")


def apply_choice(decision: Column, confidence: Column, e0: Column, e1: Column, choice: Column) -> Column:
    """struct(decision, confidence): an arbiter's choice taken into account; none leaves both as they are."""
    make = lambda d, floor: F.struct(F.lit(d).alias("decision"), F.greatest(confidence, F.lit(floor)).alias("confidence"))
    return (
        F.when(choice.isNull(), F.struct(decision.alias("decision"), confidence.alias("confidence")))
        .when(choice.eqNullSafe(e1), make("CONFIRM", 0.92))
        .when(~choice.eqNullSafe(e0), make("CORRECT", 0.88))
        .otherwise(make("CONFIRM", 0.88))
    )


def distinct_texts(items: Column, most: int = 6) -> Column:
    """Distinct non-blank texts of a list, at most `most`."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: F.btrim(x.cast("string"))), lambda x: x != "")), 1, most)


def band(confidence: Column) -> Column:
    return F.when(confidence > 0.90, "high").when(confidence >= 0.70, "medium").otherwise("low")


def decision_stats(df: DataFrame) -> DataFrame:
    """kind, name, n, percent, avg_confidence by decision, band, source and overall, in one pass."""
    named = df.select("decision", band(F.col("confidence")).alias("band"), F.coalesce("e1_source", F.lit("none")).alias("source"), "confidence")
    one = lambda c: F.grouping(c) == 0
    kind = F.when(one("decision"), "decision").when(one("band"), "band").when(one("source"), "source").otherwise("all")
    sets = [[F.col("decision")], [F.col("band")], [F.col("source")], []]
    out = named.groupingSets(sets, "decision", "band", "source").agg(kind.alias("kind"), F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
    out = out.withColumn("name", F.coalesce("decision", "band", "source", F.lit("all")))
    total = F.sum(F.when(F.col("kind") == "all", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    percent = F.when(total > 0, F.format_string("%.1f%%", 100.0 * F.col("n") / total)).otherwise("0.0%")
    return out.select("kind", "name", "n", percent.alias("percent"), F.round("avg_confidence", 6).alias("avg_confidence"))
