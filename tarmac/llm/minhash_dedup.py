"""Near-duplicates by MinHash: banded minima, signature verification, exact confirmation, components.

1. Every document becomes its set of 5-word shingles; HASHES universal hash functions give minima, and BANDS
   bands of them give bucket keys. Documents with equal sets (by 128 bits of the whole set) form a class; one row
   of each class goes on.
2. Round one: each class is held against the first class of each of its buckets, by sketches of their signatures,
   and the most similar one is confirmed on full shingle sets. A bucket of near copies of one text collapses here,
   with work in proportion to its members.
3. In buckets that still hold several components, members whose sketches (120 bytes) may belong to links are put
   into groups, each member with one row for each bucket. What these groups join are clusters; each cluster gets
   its members' full sets once, and all pairs of different components that may be links are confirmed there by
   counting common shingles. Only links between components leave a task, fewer than it has members.
   Components in one task where all links fit it, else by large-star and small-star, whose result is the same.

Nothing is capped, and no table holds pairs: they are compared inside tasks. A link can be missed only if it shares
no band or its sketches agree five standard deviations too little. Hot groups: equal sets collapse before anything is
grouped, buckets are counted with partial aggregates, and the confirmations around a hub are dealt in groups of HUB.
A bucket or cluster beyond one cell (CELL_BLOCK members, CELL_SHINGLES shingles) is dealt in pairs of chunks; the
members of its largest component are only held against the others, so that rows grow beyond proportion only if
more than a cell's members stand outside that component.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; repeated rows (the
same doc_id) are copies of each other, all kept if theirs is the smallest doc_id, and may have different texts, null
ones too; a null doc_id is never linked, its component is null and kept is false; an empty table gives an empty
table; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import hashed, mix
from .common import Workspace, slices, trim
from .components import components

SHINGLE = 5
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
#: A link's sketches agree at most so many standard deviations less than it is similar.
DEVIATIONS = 5
#: Members of a bucket or cluster, and shingles of a cluster's members, that one task holds against each other, or
#: against as many.
CELL_BLOCK, CELL_SHINGLES = 8192, 2_000_000
#: Classes confirmed against the same one in one group.
HUB = 256
_U = np.uint64


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240613)
    return r.integers(1, 1 << 63, HASHES, dtype="u8") * _U(2) + _U(1), r.integers(0, 1 << 63, HASHES, dtype="u8")


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased."""
    h, sizes = hashed([t.lower() for t in texts])
    n = len(h)
    windows = np.zeros(n, "u8")
    if n >= SHINGLE:
        part = windows[: n - SHINGLE + 1]
        for j in range(SHINGLE):
            part *= _U(0x9E3779B97F4A7C15)
            part += h[j : n - SHINGLE + 1 + j]
        part[:] = mix(part)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= SHINGLE:
            out.append(np.unique(windows[at : at + size - SHINGLE + 1]))
        elif size:
            x = np.zeros(1, "u8")
            for v in h[at : at + size]:
                x = x * _U(0xC2B2AE3D27D4EB4F) + v
            out.append(mix(x + _U(size)))
        else:
            out.append(np.empty(0, "u8"))
        at += size
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of HASHES multiply-shift functions for sets that aren't empty, 32 bits each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    a, b = _coefficients()
    out = np.empty((len(sets), HASHES), "u4")
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((flat * a[k] + b[k]) >> _U(32)).astype("u4"), starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    out = np.empty((len(sig), BANDS), "u8")
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, "u8")
        for v in sig[:, b * ROWS : (b + 1) * ROWS].T:
            x = mix(x * _U(0x9E3779B97F4A7C15) + v.astype("u8"))
        out[:, b] = x
    return out


def least_agreement(percent: int) -> float:
    p = percent / 100
    return HASHES * (p - DEVIATIONS * (p * (1 - p) / HASHES) ** 0.5)


def _class_keys(sets: list[np.ndarray]) -> list[tuple[int, int] | None]:
    """128 bits of each whole set; None for empty sets."""
    out: list = []
    for s in sets:
        x = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") if len(s) else None
        out.append(None if x is None else (int(x[0]), int(x[1])))
    return out


def _sets_of(column) -> list[np.ndarray]:
    return shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()])


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1, k2, bands, sketch of every row; k1 and k2 are null for rows that can't be linked."""

    def run(batches):
        for b in slices(batches, "text", 2_000_000):
            ids = b.column("doc_id").cast(pa.int64())
            sets = _sets_of(b.column("text"))
            sizes = np.array([len(s) for s in sets], "i8")
            full = np.flatnonzero(sizes)
            bands: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if len(full):
                sig = signatures([sets[i] for i in full])
                for i, k, s in zip(full.tolist(), band_keys(sig).view("i8").tolist(), sig.astype("u1"), strict=True):
                    bands[i], sketch[i] = k, s.tobytes()
            keys = [k if ok else None for k, ok in zip(_class_keys(sets), ids.is_valid().to_pylist(), strict=True)]
            both = [pa.array([k and k[n] for k in keys], pa.int64()) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *both, pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary")


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, HASHES)


def star_pairs(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """u, v: for each class the most similar first class of its buckets that may be linked with it; v < u."""
    least = least_agreement(percent)

    def run(batches):
        for b in batches:
            u, v = (b.column(c).to_numpy() for c in ("u", "v"))
            agree = (_sketches(b.column("su")) == _sketches(b.column("sv"))).sum(1)
            nu, nv = (b.column(c).to_numpy() for c in ("nu", "nv"))
            ok = (agree >= least) & (100 * np.minimum(nu, nv) >= percent * np.maximum(nu, nv))
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok]), pa.array(agree[ok].astype("i4"))], ["u", "v", "agree"])

    pairs = shared.where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    own = classes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    other = classes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    found = pairs.join(own.hint("merge"), "u").join(other.hint("merge"), "v").mapInArrow(run, "u long, v long, agree int")
    return found.groupBy("u").agg(F.max(F.struct("agree", "v")).alias("best")).select("u", "best.v")


def cells(rows: DataFrame, ws: Workspace) -> DataFrame:
    """key, lo, hi, b, node, label: the members of groups (key) with several labels, dealt in pairs (lo, hi) of chunks b.

    rows: key, node, label, w, the share of a cell that a member takes. Any two members of different labels meet in
    one cell; those of a large group's largest label don't meet each other, unless they are in one chunk.
    """
    sizes = rows.groupBy("key", "label").agg(F.sum("w").alias("w"))
    groups = sizes.groupBy("key").agg(F.max(F.struct("w", "label")).alias("big"), F.sum("w").alias("all"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    whole = F.col("all") <= 1
    others, own = F.greatest(F.ceil(F.col("all") - F.col("big.w")), F.lit(1)), F.greatest(F.ceil("big.w"), F.lit(1))
    groups = groups.where("lo <> hi").select("key", F.col("big.label").alias("big"), F.when(whole, 1).otherwise(others).cast("int").alias("kr"), F.when(whole, 0).otherwise(own).cast("int").alias("kl"))
    rows = rows.join(ws.write(groups, "mixed"), "key")
    place, in_big = F.xxhash64("node"), (F.col("label") == F.col("big")) & (F.col("kl") > 0)
    b = F.when(in_big, F.col("kr") + F.pmod(place, F.greatest("kl", F.lit(1)))).otherwise(F.pmod(place, F.col("kr"))).cast("int")
    last = F.when(in_big, F.col("kr") - 1).otherwise(F.col("kr") + F.col("kl") - 1)
    rows = rows.select("key", "node", "label", b.alias("b"), F.explode(F.sequence(F.lit(0), last)).alias("o"))
    return rows.select("key", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "node", "label")


def alike(s: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """For each sketch a number of its group; any two that may be a link are in one group.

    Members found are not looked at again, so that a group of similar ones takes a few passes.
    """
    least = least_agreement(percent)
    group = np.arange(len(n))
    left = np.arange(len(n))
    while len(left):
        first, left = left[0], left[1:]
        todo, sl, nl = [first], s[left], n[left]
        while todo and len(left):
            i = todo.pop()
            near = np.count_nonzero(sl == s[i], axis=1) >= least
            near &= 100 * np.minimum(nl, n[i]) >= percent * np.maximum(nl, n[i])
            if near.any():
                todo.extend(left[near].tolist())
                group[left[near]] = first
                left, sl, nl = left[~near], sl[~near], nl[~near]
    return group


def near_members(dealt: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """u, v: members of a cell's groups of similar sketches with several labels, each with its group's first member."""

    def run(t: pa.Table) -> pa.Table:
        node, label, n = (t.column(c).to_numpy() for c in ("node", "label", "n"))
        group = alike(_sketches(t.column("sketch")), n, percent)
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        several = np.zeros(len(n), bool)
        several[group[order[starts]]] = np.minimum.reduceat(label[order], starts) != np.maximum.reduceat(label[order], starts)
        at = np.flatnonzero(several[group])
        return pa.table({"u": node[at], "v": node[group[at]]})

    rows = dealt.join(classes.select("node", "n", "sketch").hint("merge"), "node")
    return rows.groupBy("key", "lo", "hi").applyInArrow(run, "u long, v long").where("u <> v")


def cell_links(label: np.ndarray, chunk: np.ndarray, s: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of links, enough to join all labels that links join; of two chunks, only links between them."""
    least, n = least_agreement(percent), np.array([len(x) for x in sets])
    starts = np.cumsum(n) - n
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes, mine = codes.astype("i4"), np.zeros(len(names), "i4")
    label = np.unique(label, return_inverse=True)[1]
    two = chunk.min() != chunk.max()
    done, out = np.zeros(len(n), bool), []
    # One end at least of each link between labels is outside the most frequent one.
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        ok = ~done & (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        done[i] = True
        if two:
            ok &= chunk != chunk[i]
        at = np.flatnonzero(ok)
        at = at[np.count_nonzero(s[at] == s[i], axis=1) >= least]
        if not len(at):
            continue
        own = codes[starts[i] : starts[i] + n[i]]
        mine[own] = 1
        size = n[at]
        if 3 * size.sum() > len(codes):
            inner = np.add.reduceat(mine[codes], starts)[at]
        else:
            begin = np.cumsum(size) - size
            inner = np.add.reduceat(mine[codes[np.arange(size.sum()) + np.repeat(starts[at] - begin, size)]], begin)
        mine[own] = 0
        at = at[100 * inner >= percent * (n[i] + size - inner)]
        old, first = np.unique(label[at], return_index=True)
        out += [(i, j) for j in at[first].tolist()]
        label[np.isin(label, old)] = label[i]
    return out


def cluster_links(dealt: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """u, v: links between components, confirmed on full sets, in each cell fewer than its members."""

    def run(t: pa.Table) -> pa.Table:
        node, label, b = (t.column(c).to_numpy() for c in ("node", "label", "b"))
        # A large component's chunk has no cell of its own, and one alone in its cell meets nothing.
        links = []
        if t.column("lo")[0] == t.column("hi")[0] or b.min() != b.max():
            links = cell_links(label, b, _sketches(t.column("sketch")), _sets_of(t.column("text")), percent)
        if t.nbytes > 4_000_000:
            trim()
        u, v = zip(*links, strict=True) if links else ((), ())
        return pa.table({"u": node[list(u)], "v": node[list(v)]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    rows = dealt.join(classes.select("node", "sketch").hint("merge"), "node").join(texts.hint("merge"), "node")
    return rows.groupBy("key", "lo", "hi").applyInArrow(run, "u long, v long")


def class_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: one text of each of the classes in nodes."""

    def run(batches):
        for b in slices(batches, "text", 2_000_000):
            keys = _class_keys(_sets_of(b.column("text")))
            same = [k == own for k, own in zip(keys, zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("text")], ["node", "text"]).filter(pa.array(same))

    wanted = classes.join(nodes, "node", "left_semi").select("node", "doc_id", "k1", "k2")
    # Grows with the corpus: always a merge join, whose cost is the same share of the input at every size.
    rows = docs.where("text is not null").join(wanted.hint("merge"), "doc_id").select("node", "k1", "k2", "text")
    return rows.mapInArrow(run, "node long, text string").groupBy("node").agg(F.first("text").alias("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs with 100 * intersection >= percent * union of their full sets.

    The classes held against the same v come in groups of HUB, and v's text once for each group.
    """
    counts = pairs.groupBy("v").agg(F.count("*").alias("m"))
    p = pairs.select("u", "v").join(counts, "v").select("v", F.pmod(F.xxhash64("u"), F.ceil(F.col("m") / HUB)).alias("part"), "u")
    heads = p.select("v", "part").distinct().select("v", "part", F.lit(0).alias("side"), F.col("v").alias("node"))
    both = heads.unionByName(p.select("v", "part", F.lit(1).alias("side"), F.col("u").alias("node")))
    rows = both.join(texts, "node").repartition("v", "part").sortWithinPartitions("v", "part", "side")

    def run(batches):
        head, mine = None, np.empty(0, "u8")
        for b in slices(batches, "text", 2_000_000):
            sets = _sets_of(b.column("text"))
            links = []
            for v, part, side, node, s in zip(*(b.column(c).to_pylist() for c in ("v", "part", "side", "node")), sets, strict=True):
                if not side:
                    head, mine = (v, part), s
                elif head == (v, part):
                    inner = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * inner >= percent * (len(mine) + len(s) - inner):
                        links.append((node, v))
            u, v = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def class_groups(docs: DataFrame, classes: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """node, label (the smallest node reachable) of all classes that are linked with others."""
    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = ws.write(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("first")).where("m > 1").select("key", "first"), "buckets")
    shared = ws.write(keyed.join(buckets, "key"), "shared")
    ws.drop(buckets)
    texts = ws.write(class_texts(docs, classes, shared.select("node").distinct()), "texts")

    def joined(links: DataFrame) -> DataFrame:
        return components(ws, links).toDF("node", "label")

    pairs = ws.write(star_pairs(shared, classes, percent), "pairs")
    labels = joined(ws.write(confirmed(pairs, texts, percent), "links"))

    def tagged(rows: DataFrame, w) -> DataFrame:
        return ws.write(rows.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), w.alias("w")), "tagged")

    share = F.lit(1.0 / CELL_BLOCK)
    near = near_members(cells(tagged(shared, share), ws), classes, percent)
    clusters = components(ws, ws.write(near, "near"))
    clusters = clusters.join(classes.select("node", "n"), "node").select("node", F.col("component").alias("key"), "n")
    dealt = cells(tagged(clusters, share + F.col("n") / CELL_SHINGLES), ws)
    links = ws.write(cluster_links(dealt, classes, texts, percent), "links")
    return labels if links.isEmpty() else joined(labels.toDF("u", "v").unionByName(links))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links are pairs with 100 * intersection >= percent * union (80 or more)."""
    if percent < 80:
        raise ValueError("the bands are made for 80 percent and more")
    ws = Workspace(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = ws.write(sign(docs), "signed")
    linked = signed.where(F.col("k1").isNotNull())
    firsts = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # A class gets its number when the table is written, once and for all.
    classes = ws.write(firsts.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = class_groups(docs, classes, ws, percent)
    members = ws.write(classes.select("node", "k1", "k2", "doc_id", "copies").join(groups, "node", "left"), "members")
    heads = ws.write(members.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("head")), "heads")
    named = members.where("label is not null or copies > 1").join(heads, "label", "left").select("k1", "k2", F.coalesce("head", "doc_id").alias("component"))
    named = ws.write(named, "named")
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each near-duplicate group, with the columns of docs; rows with a null doc_id stay."""
    ids = near_duplicates(docs, percent).where("kept").select("doc_id").distinct()
    ids = Workspace(docs.sparkSession, "minhash-kept").write(ids, "ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    one = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("doc_id"))
    left = rows.join(ids.hint("merge"), "doc_id", "left_semi").withColumn("one", one).where("one = 1").unionByName(rows.where("doc_id is null").withColumn("one", F.lit(1)))
    return left.select("row.*")
