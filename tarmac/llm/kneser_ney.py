"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text gives each document's perplexity.

Units are characters, n-grams of up to ORDER of them, each packed into a long (characters from U+0FFF on
are folded onto the symbols from FOLD on, so that neighbours in a script stay apart; about six of the 21,000 common
Chinese characters share a symbol, and some with letters of other scripts). Counts, contexts and lower orders are joined as tables sharded by their keys: first for training, then
for every distinct n-gram of the corpus; blocks of documents get their n-grams' log probabilities back and add
them up per document. A document is kept if its perplexity is within the limit of its language, a quantile
over trusted documents that training didn't see, with a margin: the pair of QUANTILES and MARGINS that best tells
them from documents of quality 0.

Every trusted document counts, by a hash of its doc_id: TRAIN_SHARE of them are the model's training text, whole, and
all others set the limits, since the model knows those it was trained on too well to judge by them. The quantiles are
exact values of that rank among all of these. No key takes all rows to one task: blocks are bounded, ranks are counted in
sorted parts, languages are only aggregated, and what blocks send to a bucket of n-grams is streamed past its n-grams.

Defined results: null and empty texts have no perplexity and aren't kept; a null language or one with few
unseen trusted documents takes the limit of all languages together; without trusted documents every document with text is
kept; null doc_id and repeated rows pass through row by row, as do repeated labels (the worst counts); an
empty table gives an empty table; very long texts make their block long. The columns asked for travel in one
struct; those named like the operator's own results are replaced by these, and keep_good has no results of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import arrow_fields, block_count, bucket_count, deal, mix, raw_texts, with_fields
from .common import Workspace, slices, trim
from .tokens import pack_bytes, unpack_bytes

ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
#: First symbol that characters beyond the last one are folded onto; Latin letters stand below.
FOLD = 0x250
#: Stands before a text, ORDER - 1 times.
BEGIN = 2
#: For trials with a smaller model: a bound on the trusted documents of each language that are trained on. None, as
#: registered, takes all of them.
TRAIN_DOCS: int | None = None
#: Share of trusted documents that are trained on; all that aren't set the limits.
TRAIN_SHARE = 0.8
#: Quantiles of unseen trusted perplexities, and margins above them, that may be the languages' limits; labels of
#: quality 0 choose one of these pairs.
QUANTILES, MARGINS = (0.95, 0.96, 0.97, 0.98, 0.99), (1.0, 1.15)
#: Languages with fewer unseen trusted documents take the limit of all: their quantile would be one outlier.
MIN_HELD = 50
BLOCK_BYTES = 16_000_000
_U = np.uint64


def gram_keys(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character of the texts in a row, and each text's number of characters.

    Texts stand in one array with their begin symbols; n-grams are put together from pairs and pairs of pairs.
    """
    codes = [np.frombuffer(t.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(c) for c in codes], "i8")
    if not sizes.sum():
        return np.empty(0, "u8"), sizes
    pad = np.full(order - 1, BEGIN, "u4")
    flat = np.concatenate([x for c in codes for x in (pad, c)])
    if flat.max() >= SYMBOLS - 1:
        flat = np.where(flat < SYMBOLS - 1, flat, FOLD + (flat - (SYMBOLS - 1)) % (SYMBOLS - FOLD))
    part = flat.astype("u8")
    key, have, width, left = None, 0, 1, order
    while left:
        if left & 1:
            if key is None:
                key, have = part, width
            else:
                n = len(flat) - have - width + 1
                key, have = key[:n] << _U(BITS * width) | part[have : have + n], have + width
        left >>= 1
        if left:
            n = len(flat) - 2 * width + 1
            part = part[:n] << _U(BITS * width) | part[width : width + n]
            width *= 2
    starts = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    return np.concatenate([key[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]), sizes


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, c: how often each n-gram of the highest order occurs in docs' texts."""

    def run(batches):
        for b in slices(batches, "text", 2_000_000):
            keys, _ = gram_keys([(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()])
            gram, c = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view("i8")), pa.array(c, pa.int64())], ["gram", "c"])

    return docs.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _low(c, n: int):
    """The last n symbols of a packed n-gram."""
    return c.bitwiseAND(F.lit((1 << (BITS * n)) - 1))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from counts of counts; a level too thin for them takes 0.5, 1, 1.5."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


class Model:
    """Tables of each order: probabilities of seen n-grams (key, p) and weights of seen contexts (ctx, g)."""

    def __init__(self, probabilities: dict[int, DataFrame], weights: dict[int, DataFrame], unseen: float):
        self.probabilities, self.weights, self.unseen = probabilities, weights, unseen


def train(docs: DataFrame, ws: Workspace, order: int = ORDER) -> Model:
    """The model of docs' texts. Counts of lower orders are numbers of different left neighbours."""
    counts = {order: ws.write(gram_counts(docs), f"counts{order}")}
    for n in range(order - 1, 0, -1):
        counts[n] = ws.write(counts[n + 1].select(_low(F.col("gram"), n).alias("gram")).groupBy("gram").agg(F.count("*").alias("c")), f"counts{n}")
    probabilities, weights = {}, {}
    unseen = 1.0 / SYMBOLS
    for n in range(1, order + 1):
        row = counts[n].agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).head()
        d1, d2, d3 = discounts(*row)
        disc = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = counts[n].select("gram", "c", F.shiftright("gram", BITS).alias("ctx"), disc.alias("d"))
        stats = ws.write(rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g")), f"contexts{n}")
        joined = rows.join(stats, "ctx").select("gram", "g", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"))
        if n == 1:
            p = joined.select(F.col("gram").alias("key"), (F.col("own") + F.col("g") / SYMBOLS).alias("p"))
            g = stats.head()
            unseen = (g["g"] if g else 1.0) / SYMBOLS
        else:
            lower = probabilities[n - 1].select(F.col("key").alias("low"), F.col("p").alias("pl"))
            p = joined.withColumn("low", _low(F.col("gram"), n - 1)).join(lower, "low").select(F.col("gram").alias("key"), (F.col("own") + F.col("g") * F.col("pl")).alias("p"))
            weights[n] = stats.select("ctx", "g")
        probabilities[n] = ws.write(p, f"p{n}")
    return Model(probabilities, weights, unseen)


def gram_logs(model: Model, grams: DataFrame, ws: Workspace, order: int = ORDER) -> DataFrame:
    """gram, lp of distinct n-grams (gram): the natural log of the interpolated probability, by joins on each order."""
    levels = {order: grams.select(F.col("gram").alias("key"))}
    for n in range(order - 1, 0, -1):
        levels[n] = ws.write(levels[n + 1].select(_low(F.col("key"), n).alias("key")).distinct(), f"keys{n}")
    p = levels[1].join(model.probabilities[1], "key", "left").select("key", F.coalesce("p", F.lit(model.unseen)).alias("p"))
    for n in range(2, order + 1):
        p = ws.write(p, f"score{n - 1}").select(F.col("key").alias("low"), F.col("p").alias("pl"))
        k = levels[n].select("key", F.shiftright("key", BITS).alias("ctx"), _low(F.col("key"), n - 1).alias("low"))
        k = k.join(p, "low").join(model.weights[n], "ctx", "left").join(model.probabilities[n], "key", "left")
        p = k.select("key", F.coalesce("p", F.col("g") * F.col("pl"), "pl").alias("p"))
    return ws.write(p.select(F.col("key").alias("gram"), F.log("p").cast("float").alias("lp")), "logs")


def _bucketed(keys: np.ndarray, buckets: int):
    """(bucket, its sorted keys) of sorted distinct keys."""
    b = (mix(keys) % _U(buckets)).astype("i4")
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(b[part[0]]), keys[part]


def _block_keys(table: pa.Table) -> np.ndarray:
    found, size = [np.empty(0, "u8")], 0
    for part in _parts(table):
        found.append(pd.unique(gram_keys(part)[0]))
        size += len(found[-1])
        if size > 1_500_000:
            found = [np.unique(np.concatenate(found))]
            size = 0
    return np.unique(np.concatenate(found))


def _parts(table: pa.Table, most: int = 300_000):
    """Runs of texts small enough for the processor's cache."""
    for chunk in table.to_batches(max_chunksize=256):
        part, size = [], 0
        for t in raw_texts(chunk.column("z")):
            if part and size + len(t) > most:
                yield part
                part, size = [], 0
            part.append(t)
            size += len(t)
        yield part


def block_grams(dealt: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, keys: each block's distinct n-grams, those of a bucket in one value."""

    def run(t: pa.Table) -> pa.Table:
        found = list(_bucketed(_block_keys(t), buckets))
        block = t.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([k for k, _ in found], pa.int32()), "block": pa.array([block] * len(found), pa.int32()), "keys": pa.array([pack_bytes([np.diff(v, prepend=_U(0)).tobytes()]) for _, v in found], pa.binary())})

    return dealt.groupBy("block").applyInArrow(run, "bucket int, block int, keys binary")


def _keys(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unpack_bytes(packed)[0], "u8"), dtype="u8")


def distinct_grams(packed: DataFrame, buckets: int) -> DataFrame:
    """bucket, gram: every n-gram of the corpus once, as a bucket holds all of its blocks."""

    def run(batches):
        have, new = np.empty(0, "u8"), []

        def merged() -> np.ndarray:
            return np.unique(np.concatenate([have, *new]))

        def rows(bucket: int, keys: np.ndarray):
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket, "i4")), pa.array(part.view("i8"))], ["bucket", "gram"])

        now = None
        for b in batches:
            for k, keys in zip(b.column("bucket").to_pylist(), b.column("keys").to_pylist(), strict=True):
                if k != now and now is not None:
                    yield from rows(now, merged())
                    have, new = np.empty(0, "u8"), []
                now = k
                new.append(_keys(keys))
                if sum(map(len, new)) > 1_000_000 + len(have):
                    have, new = merged(), []
        if now is not None:
            yield from rows(now, merged())

    return packed.select("bucket", "keys").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, gram long")


def block_logs(packed: DataFrame, logs: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, lps: log probabilities in the order of the block's keys.

    A bucket's n-grams come first, the blocks' keys stream past them: a task holds the n-grams of one bucket.
    """

    def run(batches):
        now, grams, lps, gram, lp = None, [], [], None, None
        for b in batches:
            buckets_, blocks = b.column("bucket").to_numpy(), b.column("block").to_numpy()
            out = []
            for i, end in _runs(buckets_, blocks < 0):
                if buckets_[i] != now:
                    now, grams, lps, gram = buckets_[i], [], [], None
                if blocks[i] < 0:
                    grams.append(b.column("gram").slice(i, end - i).to_numpy().view("u8").copy())
                    lps.append(b.column("lp").slice(i, end - i).to_numpy().copy())
                    continue
                if gram is None:
                    gram, lp = np.concatenate(grams), np.concatenate(lps)
                    order = np.argsort(gram)
                    gram, lp, grams, lps = gram[order], lp[order], [], []
                for block, keys in zip(blocks[i:end].tolist(), b.column("keys").slice(i, end - i).to_pylist(), strict=True):
                    out.append((block, int(now), pack_bytes([lp[np.searchsorted(gram, _keys(keys))].tobytes()])))
            cols = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "bucket", "lps"])

    first = logs.select("bucket", F.lit(-1).alias("block"), "gram", "lp", F.lit(None).cast("binary").alias("keys"))
    then = packed.select("bucket", "block", F.lit(0).cast("long").alias("gram"), F.lit(0).cast("float").alias("lp"), "keys")
    return first.unionByName(then).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block int, bucket int, lps binary")


def _runs(a: np.ndarray, b: np.ndarray):
    """(start, end) of stretches with equal values of both arrays."""
    cut = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    return zip([0, *cut.tolist()], [*cut.tolist(), len(a)], strict=True) if len(a) else ()


def block_scores(dealt: DataFrame, answers: DataFrame, columns: list[str], buckets: int, with_text: bool) -> DataFrame:
    """columns, n_symbols, perplexity (and z, the compressed text) of every document."""
    keep = [*columns, *(["z"] if with_text else [])]
    names = [*keep, "n_symbols", "perplexity"]
    schema = pa.schema(arrow_fields(dealt, keep) + [("n_symbols", pa.int64()), ("perplexity", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        keys = _block_keys(left)
        logs = np.zeros(len(keys), "f4")
        got = dict(zip(right.column("bucket").to_pylist(), right.column("lps").to_pylist(), strict=True))
        for k, part in _bucketed(keys, buckets):
            logs[np.searchsorted(keys, part)] = np.frombuffer(unpack_bytes(got[k])[0], "f4")
        sizes, sums = [], []
        for part in _parts(left):
            own, n = gram_keys(part)
            codes, uniq = pd.factorize(own)
            lp = logs[np.searchsorted(keys, uniq)].astype("f8")[codes]
            total = np.zeros(len(n))
            full = n > 0
            if full.any():
                total[full] = np.add.reduceat(lp, (np.cumsum(n) - n)[full])
            sizes.append(n)
            sums.append(total)
        n, s = np.concatenate(sizes), np.concatenate(sums)
        del keys, logs, got
        trim()
        with np.errstate(divide="ignore", invalid="ignore"):
            ppl = np.exp(-s / n)
        return pa.Table.from_arrays([left.column(c) for c in keep] + [pa.array(n), pa.array(ppl, mask=n == 0)], names=names).cast(schema)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, with_fields(dealt, keep, "", "n_symbols long, perplexity double"))


def perplexities(docs: DataFrame, model: Model, ws: Workspace, columns: list[str], with_text: bool = False) -> DataFrame:
    """columns, n_symbols, perplexity of every document under the model."""
    n = block_count(docs, BLOCK_BYTES)
    buckets = bucket_count(docs.sparkSession, n)
    dealt = deal(docs, columns, n)
    packed = ws.write(block_grams(dealt, buckets), "block-grams")
    grams = ws.write(distinct_grams(packed, buckets), "grams")
    logs = gram_logs(model, grams, ws).join(grams, "gram")
    return ws.write(block_scores(dealt, ws.write(block_logs(packed, logs, buckets), "block-logs"), columns, buckets, with_text), "scores")


def order_statistics(rows: DataFrame, shares: tuple[float, ...], ws: Workspace) -> DataFrame:
    """whole, lang, n, q: the number of perplexities of each language and, with whole and lang '', of all together, and
    for each share the smallest perplexity that this share of them is not above.

    Every row counts: different values are sorted into parts, the parts' counts tell where a rank lies, and only that
    part is counted through.
    """
    groups = F.array(F.struct(F.lit(False).alias("whole"), F.col("lang").alias("lang")), F.struct(F.lit(True).alias("whole"), F.lit("").alias("lang")))
    each = rows.where("perplexity is not null").select(F.explode(groups).alias("g"), "perplexity").where("g.lang is not null")
    counts = each.groupBy("g.whole", "g.lang", "perplexity").agg(F.count("*").alias("c"))
    placed = ws.write(counts.repartitionByRange("whole", "lang", "perplexity").withColumn("part", F.spark_partition_id()), "ranked")
    of = Window.partitionBy("whole", "lang")
    parts = placed.groupBy("whole", "lang", "part").agg(F.sum("c").alias("m"))
    parts = parts.select("*", F.sum("m").over(of).alias("n"), (F.sum("m").over(of.orderBy("part")) - F.col("m")).alias("before"))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.ceil(F.lit(s) * F.col("n")).alias("k")) for i, s in enumerate(shares)])
    wanted = parts.select("*", F.explode(ranks).alias("r")).where("r.k > before and r.k <= before + m").select("whole", "lang", "part", "n", "r.i", (F.col("r.k") - F.col("before")).alias("k"))
    upto = F.sum("c").over(Window.partitionBy("whole", "lang", "i").orderBy("perplexity"))
    found = placed.join(wanted, ["whole", "lang", "part"]).withColumn("upto", upto).where("upto >= k").groupBy("whole", "lang", "n", "i").agg(F.min("perplexity").alias("x"))
    found = found.groupBy("whole", "lang", "n").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("q"))
    return found.withColumn("q", F.col("q.x"))


def best_limit(held: DataFrame, poor: DataFrame, limits: DataFrame, common: list[float]) -> int:
    """Place of the pair whose limits keep the largest share of held less that of poor; the last of equal ones."""
    places = range(len(QUANTILES) * len(MARGINS))
    both = held.withColumn("good", F.lit(True)).unionByName(poor.withColumn("good", F.lit(False))).where("perplexity is not null")
    limit = F.coalesce("own", F.array(*map(F.lit, common)))
    kept = [F.avg((F.col("perplexity") <= limit[i]).cast("double")).alias(f"k{i}") for i in places]
    shares = {r["good"]: r for r in both.join(limits, "lang", "left").groupBy("good").agg(*kept).collect()}
    gain = [shares[True][f"k{i}"] - (shares[False][f"k{i}"] if False in shares else 0) for i in places]
    return max(places, key=lambda i: (gain[i], i))


def _classified(docs: DataFrame, labels: DataFrame, columns: list[str], with_text: bool) -> DataFrame:
    """row (a struct of the columns), n_symbols, perplexity, limit, kept of every document (and z)."""
    ws = Workspace(docs.sparkSession, "kneser-ney")
    docs = docs.select("doc_id", "lang", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    worst = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("doc_id is not null")
    trusted = docs.select("doc_id", "lang").join(worst.where("q = 1 and t = 0").select("doc_id"), "doc_id")
    place = F.xxhash64("doc_id", F.lit(11))
    split = F.pmod(place, F.lit(1000)) < int(1000 * TRAIN_SHARE)
    trusted = ws.write(trusted.select("doc_id", "lang", place.alias("place"), split.alias("train")).distinct(), "trusted")
    seen = trusted.where("train")
    if TRAIN_DOCS is not None:
        per = seen.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
        below = (F.col("place").cast("double") / 2.0**64 + 0.5) * F.col("n") < TRAIN_DOCS
        seen = seen.join(per, F.col("lang").eqNullSafe(F.col("of"))).where(below)
    seen = ws.write(seen.select("doc_id").distinct(), "seen")
    # Grows with the corpus: always a merge join, whose cost is the same share of the input at every size.
    model = train(docs.select("doc_id", "text").join(seen.hint("merge"), "doc_id", "left_semi"), ws)
    scores = perplexities(docs, model, ws, ["doc_id", "lang", "row"], with_text)
    held = scores.select("doc_id", "lang", "perplexity").join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").join(seen, "doc_id", "left_anti")
    q = F.array(*[F.col("q")[i] * m for m in MARGINS for i in range(len(QUANTILES))])
    ranked = ws.write(order_statistics(held, QUANTILES, ws).select("whole", "lang", "n", q.alias("q")), "limits")
    limits = ranked.where("not whole").select("lang", F.when(F.col("n") >= MIN_HELD, F.col("q")).alias("own"))
    common = ranked.where("whole").head()
    common = common and common["q"]
    poor = scores.select("doc_id", "lang", "perplexity").join(worst.where("q = 0").select("doc_id"), "doc_id", "left_semi")
    at = best_limit(held, poor, limits, common) if common else 0
    # One row for each language of the trusted documents.
    limits = limits.select("lang", F.col("own")[at].alias("own"))
    limit = F.coalesce("own", F.lit(common[at] if common else None).cast("double"))
    out = scores.join(limits, "lang", "left").withColumn("limit", limit)
    kept = F.when(F.col("limit").isNull(), F.col("perplexity").isNotNull()).otherwise(F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(False)))
    return out.select("row", "n_symbols", "perplexity", "limit", kept.alias("kept"), *(["z"] if with_text else []))


def classify(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n_symbols, perplexity, limit, kept of every document.

    labels: doc_id, quality, toxic (0 or 1); trusted are documents of quality 1 that aren't toxic.
    """
    own = ["n_symbols", "perplexity", "limit", "kept"]
    columns = [c for c in columns if c not in own]
    return _classified(docs, labels, columns, False).select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *own)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with the columns of docs, whatever their names."""
    columns = [c for c in docs.columns if c != "text"]
    kept = _classified(docs, labels, columns, True).where("kept").select("row", "z")

    def run(batches):
        for b in slices(batches, "z", 1_000_000, 512):
            texts = pa.array([t.decode("utf-8", "surrogatepass") for t in raw_texts(b.column("z"))], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), texts], ["row", "text"])

    out = kept.mapInArrow(run, with_fields(kept, ["row"], "", "text string"))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, ["doc_id", "lang"])
