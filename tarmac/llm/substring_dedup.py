"""Repeated passages: recurring windows are confirmed, compiled into automata, and located in all documents.

1. Anchors: of each window of W words, the least hash of its k-word stretches. Equal windows have equal anchors,
   and few stretches are anchors. Anchors that occur once can't belong to a repeated window.
2. Windows with a recurring anchor are hashed whole (128 bits) and counted over the corpus: recurring windows.
3. Each block of documents gets the recurring windows it holds. What stands at the first place of each window
   within the block makes up its passages; their stretches of half a window go into the block's own
   Aho-Corasick automaton over words, and all documents of the block are streamed through it. A hit is an
   occurrence if the words around it continue as in a passage for a whole window, which exact names of the
   words to its left and right tell; no hash of the text takes part. Occurrences are all that is removed.

Every step is keyed by hashes or blocks; a passage in a third of all documents adds one row for each block and
window, and the work on a block grows with its words (but for sorting), periodic texts included. Windows are judged
on the input. Windows are counted by 128 bits and come back to their blocks by the first 64; a window of the
same block that shares just these is expected once in some 10^7 blocks.

Defined results: null and empty texts have no words and lose none; repeated rows are occurrences of each other;
null doc_id passes through; an empty table gives an empty table; very long texts make their block long. The
other columns travel in one struct, so that no name clashes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, arrow_fields, block_count, deal, grams, hashed, mix, raw_texts, runs, with_fields, word_hashes, words_in
from .common import Workspace, trim

W = 35
_U = np.uint64
_TOP = np.iinfo("u8").max


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width] for each i where that fits."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def _places(sizes: np.ndarray, n: int, k: int) -> np.ndarray:
    """Whether k values from each of the first n places lie within one text."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    return np.arange(n) + k <= ends[:n]


def anchors(h: np.ndarray, sizes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every place: the anchor of the window that starts there (0: none); hashes of the anchors' own places."""
    k = w // 2 + 1
    span = w - k + 1
    if len(h) < w:
        return np.zeros(len(h), "u8"), np.empty(0, "u8"), np.zeros(len(h), bool)
    g = grams(h, k) | _U(1)
    g[~_places(sizes, len(g), k)] = _TOP
    least = _sliding(g, span, np.minimum)
    fits = _places(sizes, len(least), w)
    least = np.where(fits, least, _U(0))
    padded = np.concatenate([np.zeros(span - 1, "u8"), least, np.zeros(span - 1, "u8")])
    chosen = _sliding(padded, span, np.maximum)[: len(g)] == g
    chosen &= g != _TOP
    whole = np.zeros(len(h), "u8")
    whole[: len(least)] = least
    at = np.zeros(len(h), bool)
    at[: len(fits)] = fits
    return whole, g[chosen], at


def window_keys(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the w words from each place on."""
    return grams(h, w), grams(mix(h ^ _U(0x5851F42D4C957F2D)), w, 0xD6E8FEB86659FD93)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view("i8"))


def anchor_rows(dealt: DataFrame, w: int) -> DataFrame:
    """block, a, n: anchors of a stretch of a block's texts, n is 1 or 2 (or more)."""

    def run(batches):
        for b in batches:
            blocks = b.column("block").to_numpy()
            texts = raw_texts(b.column("z"))
            for block in np.unique(blocks).tolist():
                mine = [t for t, x in zip(texts, blocks.tolist(), strict=True) if x == block]
                for part in runs(mine):
                    _, own, _ = anchors(*hashed(part), w)
                    a, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), block, "i4")), _long(a), pa.array(np.minimum(n, 2).astype("i4"))], ["block", "a", "n"])
        trim()

    return dealt.mapInArrow(run, "block int, a long, n int")


def recurring(rows: DataFrame, keys: list[str]) -> DataFrame:
    """block and first key of rows whose keys occur twice or more over all blocks, once for each block."""
    seen = F.sum("n").over(Window.partitionBy(*keys))
    return rows.select("block", keys[0], seen.alias("seen")).where("seen > 1").select("block", keys[0])


def _group_parts(table: pa.Table):
    for chunk in table.to_batches(max_chunksize=512):
        yield from runs(raw_texts(chunk.column("z")))


def window_rows(dealt: DataFrame, recurring_anchors: DataFrame, w: int) -> DataFrame:
    """block, a, b, n: windows of each block whose anchor recurs; n is 1 or 2 (or more)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())])
        known = np.unique(right.column("a").to_numpy().view("u8"))
        keys = []
        for part in _group_parts(left):
            h, sizes = hashed(part)
            least, _, fits = anchors(h, sizes, w)
            at = np.flatnonzero(fits & _among(least, known))
            if len(at):
                a, b = window_keys(h, w)
                keys.append(np.stack([a[at], b[at]], 1))
        if not keys or not left.num_rows:
            return schema.empty_table()
        both = np.concatenate(keys)
        del keys
        trim()
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        new = np.r_[True, (both[1:] != both[:-1]).any(1)]
        first = np.flatnonzero(new)
        n = np.minimum(np.diff(np.r_[first, len(both)]), 2)
        block = left.column("block")[0].as_py()
        return pa.Table.from_arrays([pa.array(np.full(len(first), block, "i4")), _long(both[first, 0].copy()), _long(both[first, 1].copy()), pa.array(n.astype("i4"))], schema=schema)

    return dealt.groupBy("block").cogroup(recurring_anchors.groupBy("block")).applyInArrow(run, "block int, a long, b long, n int")


#: Word numbers are written as three characters of different ranges, so that automaton nodes have few children
#: and stretches only match where words begin.
_BASE = 128
_FIRST = 0x100
#: Hits that are named at once.
_HITS = 250_000


def _spelled(words: np.ndarray) -> str:
    """Word numbers as a string of three characters each."""
    out = np.empty((len(words), 3), "<u4")
    out[:, 0] = 0x10000 + words // (_BASE * _BASE)
    out[:, 1] = _FIRST + words // _BASE % _BASE
    out[:, 2] = _FIRST + _BASE + words % _BASE
    return out.tobytes().decode("utf-32-le")


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return pd.Series(x).isin(known).to_numpy() if len(known) else np.zeros(len(x), bool)


class Block:
    """The words of a block's texts as numbers in one array, 0 after each text."""

    def __init__(self, parts):
        found = [words_in(part) for part in parts]
        self.sizes = np.concatenate([n for _, n in found]) if found else np.empty(0, "i8")
        known = pa.concat_arrays([x for x, _ in found]).dictionary_encode() if found else pa.array([], pa.large_string()).dictionary_encode()
        numbers = known.indices.to_numpy(zero_copy_only=False).astype("i4") + 1
        self.words = np.insert(numbers, np.cumsum(self.sizes), 0)
        self.hashes = np.r_[_U(0), word_hashes(known.dictionary)]
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1

    def windows(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of the w words from each place on, and whether they lie within one text."""
        h = self.hashes[self.words]
        return *window_keys(h, w), _places(self.sizes + 1, max(len(h) - w + 1, 0), w + 1)

    def passages(self, known: np.ndarray, w: int) -> list[np.ndarray]:
        """Words at the first place within the block of every recurring window; windows that follow each other make one passage."""
        keys, _, fits = self.windows(w)
        at = np.flatnonzero(fits)
        at = at[_among(keys[at], known)]
        at = at[~pd.Series(keys[at]).duplicated().to_numpy()]
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        return [self.words[run[0] : run[-1] + w] for run in np.split(at, cuts) if len(run)]


class Passages:
    """Automaton over the words of one block's recurring passages, and what stands around its stretches."""

    def __init__(self, passages: list[np.ndarray], w: int):
        import ahocorasick

        self.w, self.step = w, w // 2 + 1
        self.reach = reach = w - self.step
        gap = np.zeros(reach, "i4")
        #: All passages in a row, with gaps that no stretch's surroundings can bridge.
        self.words = np.concatenate([x for p in passages for x in (gap, p)] + [gap])
        lengths = np.array([len(p) for p in passages], "i8")
        begins = np.cumsum(lengths + reach) - lengths
        self.at = np.concatenate([np.arange(b, b + n - self.step + 1, self.step) for b, n in zip(begins.tolist(), lengths.tolist(), strict=True)])
        spelled = _spelled(self.words)
        self.auto, self.stretch, known = ahocorasick.Automaton(), np.empty(len(self.at), "i8"), {}
        for i, a in enumerate(self.at.tolist()):
            key = spelled[3 * a : 3 * (a + self.step)]
            if key not in known:
                known[key] = len(known)
                self.auto.add_word(key, known[key])
            self.stretch[i] = known[key]
        self.auto.make_automaton()

    def windows(self, words: np.ndarray) -> np.ndarray:
        """Places where a window of a passage starts, word for word; words are those of all texts, 0 between them."""
        found = np.zeros(len(words), bool)
        hits = np.array(list(self.auto.iter(_spelled(words))), "i8").reshape(-1, 2)
        at, stretch = hits[:, 0] // 3 - self.step + 1, hits[:, 1]
        padded = np.concatenate([np.zeros(self.reach, "i4"), words, np.zeros(self.reach, "i4")])
        for i in range(0, len(at), _HITS):
            self._name(padded, at[i : i + _HITS], stretch[i : i + _HITS], found)
        return found

    def _name(self, padded: np.ndarray, at: np.ndarray, stretch: np.ndarray, found: np.ndarray) -> None:
        """Mark the windows around hits that are windows of a passage.

        A stretch with j words to its left, or right, gets a number of its own: equal words, equal numbers, hits and
        passages alike. A window is a pair of such numbers.
        """
        own = len(self.at)
        first = np.concatenate([self.stretch, stretch])
        here = at + self.reach

        def names(step: int) -> list[np.ndarray]:
            out = [first.astype("i8")]
            for j in range(1, self.reach + 1):
                off = -j if step < 0 else self.step - 1 + j
                word = np.concatenate([self.words[self.at + off], padded[here + off]])
                gone = (word == 0) | (out[-1] < 0)
                code = pd.factorize(out[-1] << 32 | word)[0]
                code[gone] = -1
                out.append(code)
            return out

        left, right = names(-1), names(1)
        for j in range(self.reach + 1):
            a, b = left[j], right[self.reach - j]
            whole = (a >= 0) & (b >= 0)
            pair = a << 32 | b
            hit = whole[own:] & _among(pair[own:], pair[:own][whole[:own]])
            found[at[hit] - j] = True


def _covered(windows: np.ndarray, w: int) -> np.ndarray:
    """Words of the windows that start at the marked places."""
    edge = np.zeros(len(windows) + w + 1, "i4")
    at = np.flatnonzero(windows)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + w, 1)
    return np.cumsum(edge)[: len(windows)] > 0


def occurrences(parts, known: np.ndarray, w: int) -> tuple[Block, np.ndarray]:
    """The block of these texts and which of its words occurrences of the known windows cover."""
    block = Block(parts)
    passages = block.passages(known, w) if len(known) else []
    if not passages:
        return block, np.zeros(len(block.words), bool)
    return block, _covered(Passages(passages, w).windows(block.words), w)


def locate(dealt: DataFrame, windows: DataFrame, finish, schema: pa.Schema, columns: list[str], w: int = W) -> DataFrame:
    """columns and finish(words, covered) of every document, streamed through its block's automaton."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.unique(right.column("a").to_numpy().view("u8"))
        block, gone = occurrences(_group_parts(left), known, w)
        any_gone = np.add.reduceat(gone, block.begins) if len(gone) else []
        rows, k = [], 0
        for part in _group_parts(left):
            for raw in part:
                b, n = int(block.begins[k]), int(block.sizes[k])
                rows.append(finish(raw, n, gone[b : b + n] if any_gone[k] else None))
                k += 1
        del block, gone
        trim()
        cols = list(zip(*rows, strict=True))
        arrays = [left.column(c) for c in columns] + [pa.array(v, f.type) for v, f in zip(cols, schema, strict=True)]
        return pa.Table.from_arrays(arrays, [*columns, *schema.names])

    empty = pa.schema(arrow_fields(dealt, columns) + [(f.name, f.type) for f in schema]).empty_table()
    ddl = with_fields(dealt, columns, "", ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema))
    return dealt.groupBy("block").cogroup(windows.groupBy("block")).applyInArrow(lambda left, right: run(left, right) if left.num_rows else empty, ddl)


_DDL = {pa.int64(): "bigint", pa.string(): "string"}


def recurring_windows(ws: Workspace, dealt: DataFrame, w: int = W) -> DataFrame:
    """block, a: windows that occur twice or more over all documents, for each block that holds them."""
    candidates = ws.write(recurring(anchor_rows(dealt, w), ["a"]).distinct(), "anchors")
    out = ws.write(recurring(window_rows(dealt, candidates, w), ["a", "b"]), "windows")
    ws.drop(candidates)
    return out


def _kept(raw: bytes, covered: np.ndarray) -> bytes:
    return b" ".join(compress(raw.split(), (~covered).tolist()))


def _digest(raw: bytes, n: int, covered: np.ndarray | None) -> tuple:
    kept = b" ".join(raw.split()) if covered is None else _kept(raw, covered)
    return n, 0 if covered is None else int(covered.sum()), hashlib.sha256(kept).hexdigest()


def _clean(raw: bytes, n: int, covered: np.ndarray | None) -> tuple:
    """The text without its removed words: as it was if none went, else the kept words joined by spaces."""
    if covered is None:
        return raw.decode("utf-8", "surrogatepass"), 0
    return _kept(raw, covered).decode("utf-8", "surrogatepass"), int(covered.sum())


def _cleaned(docs: DataFrame, columns: list[str], w: int, block_bytes: int) -> DataFrame:
    """row (a struct of the columns), text, n_removed."""
    ws = Workspace(docs.sparkSession, "substring-dedup")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text") if columns else docs.select(F.struct(F.lit(0).alias("none")).alias("row"), "text")
    dealt = deal(rows, ["row"], block_count(rows, block_bytes))
    return locate(dealt, recurring_windows(ws, dealt, w), _clean, pa.schema([("text", pa.string()), ("n_removed", pa.int64())]), ["row"], w)


def remove_repeats(docs: DataFrame, columns: list[str], w: int = W, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """columns of docs (text excepted) with the cleaned `text` and `n_removed`, which replace columns of these names."""
    columns = [c for c in columns if c not in ("text", "n_removed")]
    return _cleaned(docs, columns, w, block_bytes).select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "text", "n_removed")


def without_repeats(docs: DataFrame, w: int = W, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with cleaned texts and all their other columns as they were, whatever their names."""
    columns = [c for c in docs.columns if c != "text"]
    out = _cleaned(docs, columns, w, block_bytes)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ws = Workspace(spark, "substring-dedup")
    dealt = deal(docs, ["doc_id"], block_count(docs, BLOCK_BYTES))
    return locate(dealt, recurring_windows(ws, dealt), _digest, pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]), ["doc_id"])
