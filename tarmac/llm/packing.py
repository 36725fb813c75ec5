"""Packing of tokenized documents: first-fit decreasing with a tournament tree of bin capacities.

Documents are dealt at random into groups of a bounded number of tokens, and each group is packed on its own,
in one task. Whole sequences are cut off long documents first; what is left of each document is placed by
first-fit decreasing, the leftmost bin with enough room found by descending a tree of the largest capacities.
Then the emptiest bins are cut up to fill the gaps of the others, and the one bin left over is split into
sequences whose lengths are powers of two, which need no padding.

Defined results: null and empty texts are packed as their end id alone; null doc_id and repeated rows are packed
row by row; ties in length go by doc_id, then by content; an empty table gives an empty table; only doc_id and
text are read.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, total_bytes, trim
from .tokens import char_table

LENGTH = 2048
END = 1
#: Bytes of text of a group: some two million tokens, packed in one task.
GROUP_BYTES = 8_000_000
SEED = 20240229
CACHE_WORDS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A lower-case word of Latin letters, then ASCII marks without the apostrophe: two stretches the tokenizer splits off whole.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch


class Words(dict):
    """White-space separated word -> its ids as little-endian 16-bit numbers.

    Plain words go to the tokenizer's model, stretch by stretch, which saves most of a call's cost; all others
    go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_padding()
        self.t.no_truncation()
        if self.t.get_vocab_size() > 1 << 16 or sys.byteorder != "little":
            raise ValueError("ids must fit 16 bits, on a little-endian machine")
        self.model = self.t.model
        self.chars = char_table()
        self.stretches: dict[str, bytes] = {"": b""}

    def _stretch(self, x: str) -> bytes:
        got = self.stretches.get(x)
        if got is None:
            mapped = x if x.isascii() else x.encode().decode("latin-1").translate(self.chars)
            got = self.stretches[x] = array("H", [k.id for k in self.model.tokenize(mapped)]).tobytes()
        return got

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS or len(self.stretches) > CACHE_WORDS:
            self.clear()
            self.stretches = {"": b""}
        m = _PLAIN(word.lower())
        ids = self._stretch(m[1]) + self._stretch(m[2]) if m else array("H", self.t.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids


_CONTROLS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[^\\S\x1c-\x1f]+")


def _split(text: str) -> list[str]:
    """Words between Unicode white space; Python also counts the separators 1C-1F as white space, the tokenizer doesn't."""
    return [w for w in _WHITE.split(text) if w] if _CONTROLS.search(text) else text.split()


@lru_cache(1)
def words_for(path: str) -> Words:
    return Words(path)


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian 16-bit numbers) of whole texts, with the end id.

    The tokenizer drops white space and lower-cases single characters, so that a text's ids are those of its
    white-space separated words in order; each worker encodes a word when it first meets it.
    """
    path = path or default_path()
    end = np.array([END], "<u2").tobytes()

    def run(batches):
        known = words_for(path)
        for b in slices(batches, "text", 2_000_000):
            ids = [b"".join(map(known.__getitem__, _split(t or ""))) + end for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


class Tournament:
    """Largest free room over bins: the leftmost bin with enough room in logarithmic time."""

    def __init__(self, n: int, room: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tree = [room] * (2 * self.size)

    def take(self, need: int) -> int:
        """Put `need` into the leftmost bin with room for it; there is one bin for each item, so one fits."""
        t, i = self.tree, 1
        while i < self.size:
            i *= 2
            if t[i] < need:
                i += 1
        bin_ = i - self.size
        t[i] -= need
        while i > 1:
            i //= 2
            t[i] = max(t[2 * i], t[2 * i + 1])
        return bin_


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def pack(lengths: list[int], room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of pieces (item, start, length), for items given in decreasing length.

    Every token of every item lies in one piece. A sequence that isn't full has a power of two tokens.
    """
    done, rest = [], []
    for k, n in enumerate(lengths):
        full = n // room
        done += [[(k, i * room, room)] for i in range(full)]
        if n % room:
            rest.append((n - full * room, k, full * room))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(len(rest), room) if rest else None
    bins: list[list[tuple[int, int, int]]] = []
    for n, k, start in rest:
        at = tree.take(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((k, start, n))
    fill = [sum(p[2] for p in b) for b in bins]
    done += [b for b, f in zip(bins, fill, strict=True) if f == room]
    open_ = sorted((i for i, f in enumerate(fill) if f < room), key=lambda i: (-fill[i], i))
    left, right = 0, len(open_) - 1
    while left < right:
        target, source = bins[open_[left]], bins[open_[right]]
        gap = room - fill[open_[left]]
        while gap and source:
            k, start, n = source.pop()
            cut = min(gap, n)
            if cut < n:
                source.append((k, start, n - cut))
            target.append((k, start + n - cut, cut))
            gap -= cut
            fill[open_[left]] += cut
            fill[open_[right]] -= cut
        if not gap:
            done.append(target)
            left += 1
        if not source:
            right -= 1
    if left == right and left < len(open_):
        done += _binary(bins[open_[left]])
    return done


def _binary(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Split what is left over into sequences of powers of two, the largest first."""
    total, out, queue = sum(p[2] for p in pieces), [], pieces[::-1]
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        seq = []
        while want:
            k, start, n = queue.pop()
            cut = min(n, want)
            seq.append((k, start, cut))
            if cut < n:
                queue.append((k, start + cut, n - cut))
            want -= cut
        out.append(seq)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(tokens: DataFrame, groups: int, room: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of (doc_id, ids) packed in `groups` random groups; with_ids adds each piece's ids."""

    def run(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        doc = table.column("doc_id").to_pylist()
        ids = table.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), doc[i] is None, doc[i] or 0, ids[i]))
        rows = []
        for s, seq in enumerate(pack([len(ids[i]) // 2 for i in order], room)):
            offset = 0
            for k, start, n in seq:
                i = order[k]
                part = np.frombuffer(ids[i], "<u2", n, 2 * start).astype("<u4")
                rows.append((doc[i], start, n, zlib.crc32(part.tobytes()), len(ids[i]) // 2, (group << 32) + s, offset, *([part.tolist()] if with_ids else [])))
                offset += n
        names = _NAMES + ["ids"] * with_ids
        return pa.Table.from_arrays([pa.array(c, pa.list_(pa.int32()) if x == "ids" else pa.int64()) for x, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    grp = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "ids"), F.lit(groups)).alias("grp")
    return tokens.select(grp, "doc_id", "ids").groupBy("grp").applyInArrow(run, PIECES + ", ids array<int>" * with_ids)


def packed(docs: DataFrame, path: str | None = None, group_bytes: int = GROUP_BYTES, with_ids: bool = False) -> DataFrame:
    groups = max(1, -(-total_bytes(docs, "text") // group_bytes))
    return pack_documents(tokenize(docs, path), groups, with_ids=with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
