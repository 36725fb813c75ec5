"""TF-IDF as tables: postings, document frequencies, and similarity by a join on terms.

idf = ln((1 + N) / (1 + df)) + 1; a document's weights are counts times idf, scaled to length one; a score is the
sum of products over shared terms. Terms outside the vocabulary don't count in a query's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"(?U)\w\w+"
CODE_WORD = r"(?U)[\w\-/.]{2,}"


def terms(text: Column, n: tuple[int, int] = (1, 2), token: str = WORD) -> Column:
    """n-grams of the lower-case tokens, joined by one space."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(token), F.lit(0))

    def grams(k: int) -> Column:
        if k == 1:
            return words
        return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(k) for k in range(n[0], n[1] + 1)])


def term_counts(docs: DataFrame, key: str, text: str, n=(1, 2), token: str = WORD) -> DataFrame:
    """key, term, tf. Words are made a column first, so that each text is cut once."""
    return docs.select(key, terms(F.col(text), n, token).alias("t")).select(key, F.explode("t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit(counts: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """term, df, idf. max_features keeps the most frequent terms of the corpus, ties by term."""
    freq = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features:
        freq = freq.orderBy(F.desc("total"), "term").limit(max_features)
    return freq.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weigh(counts: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """key, term, w: rows of length one."""
    raw = counts.join(vocabulary, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("x") / norm).alias("w"))


def similarities(queries: DataFrame, classes: DataFrame, query_key: str, class_key: str) -> DataFrame:
    """query_key, class_key, score for pairs that share a term.

    Catalog classes have a bounded number of terms each; Spark broadcasts the postings only if their size allows,
    and otherwise joins by term, where a frequent term's partition can be split.
    """
    q, c = queries.select(query_key, "term", F.col("w").alias("wq")), classes.select(class_key, "term", F.col("w").alias("wc"))
    return q.join(c, "term").groupBy(query_key, class_key).agg(F.sum(F.col("wq") * F.col("wc")).alias("score"))


def top_k(scores: DataFrame, query_key: str, class_key: str, k: int, least: float = 0.0) -> DataFrame:
    """The k best classes of a query, ties by class; at least `least`, and never without a shared term."""
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), class_key))
    return scores.where((F.col("score") > 0) & (F.col("score") >= least)).withColumn("rank", rank).where(F.col("rank") <= k)


def class_keywords(weights: DataFrame, members: DataFrame, key: str, label: str, k: int = 15) -> DataFrame:
    """label, term, mean: the k terms of the highest mean weight over all documents of a class, ties by term."""
    size = members.groupBy(label).agg(F.count("*").alias("n"))
    sums = weights.join(members.select(key, label), key).groupBy(label, "term").agg(F.sum("w").alias("s"))
    mean = sums.join(size, label).select(label, "term", (F.col("s") / F.col("n")).alias("mean"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("mean"), "term"))
    return mean.where("mean > 0").withColumn("rank", rank).where(F.col("rank") <= k)


def class_samples(weights: DataFrame, members: DataFrame, key: str, label: str, text: str, k: int = 3, cut: int = 240, prefer: int = 40) -> DataFrame:
    """label, sample, rank: texts of the highest total weight, cut; those of `prefer` characters first; distinct."""
    total = weights.groupBy(key).agg(F.sum("w").alias("s"))
    rows = members.join(total, key).select(label, F.substring(text, 1, cut).alias("sample"), "s")
    one = rows.where(F.length("sample") > 0).groupBy(label, "sample").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.length("sample") >= prefer), F.desc("s"), "sample"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select(label, "sample", "rank")
