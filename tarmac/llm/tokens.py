"""BPE encoding and decoding over a table of distinct words.

Texts are dealt into blocks; each block's distinct words go to a table of words in buckets by their hash, packed, one
value for a block and bucket. A bucket's task takes its words from all blocks in a row and encodes each distinct word of
the corpus once; there, too, the word's ids are joined to the fixed id-to-piece table of the vocabulary. Ids come
back to the block, with the decoded bytes where they differ from the word, and are joined to the text by position:
texts are cut, coded and put together as arrays, without an object for each word that stands in them.
A task holds one block, or the distinct words of one bucket; buckets grow with the root of the number of blocks.

`decode` is the same join as a DataFrame, for ids as such; the query doesn't explode every position for it, as that
would shuffle a row for each token.

A word here is a stretch of text at whose ends the tokenizer's own pre-tokenization always splits, so that the
ids of the words in order are the ids of the text; white space of other kinds stays inside a word. Only
the text between such places reaches the library, whole.

Defined results: null text counts as empty and has no ids; null doc_id and repeated rows pass through row by
row; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, bucket_count, deal, raw_texts, runs, word_hashes

#: Bytes of text of a block: bounds the memory of a task.
BLOCK_BYTES = 16_000_000
#: What a byte can be; of characters beyond ASCII only Latin letters count as letters, and white space as the Unicode
#: tables know it, or once knew it, is found by its bytes.
_SPACE, _WHITE, _LETTER, _MARK, _LEAD = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, "u1")
_CLASS[[0x20, 0x0A]] |= _SPACE
_CLASS[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] |= _WHITE
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]] |= _LETTER
_CLASS[[*b".,"]] |= _MARK
_CLASS[[0xC2, 0xC3, 0xE1, 0xE2, 0xE3]] |= _LEAD
_WIDE = np.array([0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def load(path: str):
    """The tokenizer with truncation and padding off, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(1)
def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level piece stands for: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_table() -> dict[int, str]:
    """str.translate table from bytes, as Latin-1 characters, to the characters of byte-level pieces."""
    return {b: c for c, b in byte_of_char().items()}


@lru_cache(2)
def pieces(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; added tokens stand for their text."""
    t = load(path)
    added = {i: x.content for i, x in t.get_added_tokens_decoder().items()}
    chars = byte_of_char()
    return [added[i].encode() if i in added else bytes(chars[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())]


def _starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places, in order, where words start in texts in a row (UTF-8): edges, and those where the tokenizer always splits.

    These are before a space or a newline after a character that isn't white space, after a single newline before
    such a character, and before a full stop or comma after a letter or digit. At these places patterns start anew and
    white-space patterns can't reach across, whatever the words are; each place is judged by the bytes beside it.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(kind & _LEAD)
    if len(lead):
        first, a, b = data[lead].astype("i8"), *(data[np.minimum(lead + k, len(data) - 1)].astype("i8") for k in (1, 2))
        kind[lead[(first == 0xC3) & (a != 0x97) & (a != 0xB7)] + 1] |= _LETTER
        two = lead[(first == 0xC2) & ((a == 0x85) | (a == 0xA0))]
        three = lead[np.isin(first << 16 | a << 8 | b, _WIDE)]
        kind[np.concatenate([two, two + 1, three, three + 1, three + 2])] |= _WHITE
    solid, text = (kind & _WHITE) == 0, np.zeros(len(data), bool)
    text[edges[edges < len(data)]] = True
    start = text.copy()
    start[1:] |= solid[:-1] & (kind[1:] & _SPACE != 0)
    start[1:] |= (kind[:-1] & _LETTER != 0) & (kind[1:] & _MARK != 0)
    line = np.flatnonzero(data[:-1] == 0x0A)
    line = line[solid[line + 1] & (text[line] | solid[line - 1])]
    start[line + 1] = True
    return np.flatnonzero(start)


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts in a row, a view of their bytes, and the number of words of each text."""
    data, edges = b"".join(texts), np.cumsum([0, *map(len, texts)], dtype="i8")
    at = np.append(_starts(np.frombuffer(data, "u1"), edges[:-1]), len(data)).astype("i8")
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return words, np.diff(np.searchsorted(at, edges))


def split_words(text: str) -> list[str]:
    """The words of one text."""
    return [w.decode("utf-8", "surrogatepass") for w in cut_words([text.encode("utf-8", "surrogatepass")])[0].to_pylist()]


#: Letters, or marks without the apostrophe, after at most one space: one stretch of the tokenizer's own splitting.
_PLAIN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+)|\n").fullmatch
_SPECIAL = re.compile(r"<\|")


class WordIds(dict):
    """word -> ids as little-endian 32-bit numbers, each encoded once.

    A word that is one stretch goes to the tokenizer's model at once; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer, self.chars = load(path), char_table()
        self.model = self.tokenizer.model

    def learn(self, words) -> list[str]:
        """Encode the words that are new, and return them."""
        new = list(dict.fromkeys(w for w in words if w not in self))
        other = []
        for w in new:
            if not _PLAIN(w) or _SPECIAL.search(w):
                other.append(w)
                continue
            if w.isascii():  # printable characters stand for themselves, a space and a line's end have their own
                mapped = w.replace(" ", self.chars[0x20]).replace("\n", self.chars[0x0A])
            else:
                mapped = w.encode().decode("latin-1").translate(self.chars)
            self[w] = np.array([k.id for k in self.model.tokenize(mapped)], "<u4").tobytes()
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self[w] = np.array(e.ids, "<u4").tobytes()
        return new


def _pack(sizes: np.ndarray, content) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.append(len(sizes), sizes).astype("<u4").tobytes() + content)


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<u4", n, 4).astype("i8"), raw[4 + 4 * n :]


def pack_bytes(parts: list[bytes]) -> bytes:
    """Byte strings as one compressed one: their number, lengths and contents."""
    return _pack(np.array([*map(len, parts)], "u4"), b"".join(parts))


def unpack_bytes(packed: bytes) -> list[bytes]:
    sizes, content = _unpack(packed)
    ends = np.cumsum(sizes).tolist()
    return [content[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _ends(strings: pa.Array) -> np.ndarray:
    """Where the strings of a large binary array start in its data, and where the last one ends."""
    return np.frombuffer(strings.buffers()[1], "i8")[strings.offset : strings.offset + len(strings) + 1]


def _block_words(table: pa.Table) -> tuple[pa.ChunkedArray, list[np.ndarray]]:
    """All words of a block, in runs of texts, and the number of words of each text."""
    texts = (raw for chunk in table.to_batches(max_chunksize=256) for raw in raw_texts(chunk.column("z")))
    cut = [cut_words(part) for part in runs(texts)]
    return pa.chunked_array([w for w, _ in cut], pa.large_binary()), [n for _, n in cut]


def _vocabulary(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct words by bucket, within a bucket by their bytes, and where each bucket starts and ends.

    It is the same list of words whenever it is made from the same texts.
    """
    order = pc.array_sort_indices(words).to_numpy()
    bucket = (word_hashes(words) % np.uint64(buckets)).astype("i8")[order]
    by = np.argsort(bucket, kind="stable")
    return order[by], np.searchsorted(bucket[by], np.arange(buckets + 1))


def distinct_words(dealt: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, words: each block's distinct words, those of a bucket in one value."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        words = _block_words(table)[0].unique()
        order, at = _vocabulary(words, buckets)
        words = words.take(pa.array(order))
        ends, data = _ends(words), memoryview(words.buffers()[2] or b"")
        own = np.flatnonzero(np.diff(at)).tolist()
        packed = [_pack(np.diff(ends[at[k] : at[k + 1] + 1]), data[ends[at[k]] : ends[at[k + 1]]]) for k in own]
        return pa.table({"bucket": pa.array(own, pa.int32()), "block": pa.array([block] * len(own), pa.int32()), "words": pa.array(packed, pa.binary())})

    return dealt.groupBy("block").applyInArrow(run, "bucket int, block int, words binary")


def encode_words(words: DataFrame, buckets: int, path: str) -> DataFrame:
    """bucket, block, ids, other: every word belongs to one bucket, whose task encodes it once for all blocks.

    other: for each word 1 and its decoded bytes, or nothing where these are the word; null if all are.
    """

    def run(batches):
        now, known, differs, piece = None, None, {}, pieces(path)
        for b in batches:
            out, other = [], []
            for bucket, packed in zip(b.column("bucket").to_pylist(), b.column("words").to_pylist(), strict=True):
                if bucket != now:
                    now, known, differs = bucket, WordIds(path), {}
                raw = unpack_bytes(packed)
                ws = [w.decode("utf-8", "surrogatepass") for w in raw]
                for w in known.learn(ws):
                    decoded = b"".join([piece[i] for i in np.frombuffer(known[w], "<u4").tolist()])
                    if decoded != w.encode("utf-8", "surrogatepass"):
                        differs[w] = b"\1" + decoded
                out.append(pack_bytes([known[w] for w in ws]))
                other.append(pack_bytes([differs.get(w, b"") for w in ws]) if differs and not differs.keys().isdisjoint(ws) else None)
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("block"), pa.array(out, pa.binary()), pa.array(other, pa.binary())], ["bucket", "block", "ids", "other"])

    return words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, block int, ids binary, other binary")


def _joined_ids(right: pa.Table, words: pa.Array, at: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each of a block's words in order: the number of its ids, its ids in decimal, each before a comma, and its decoded bytes."""
    sizes, flat, texts = [np.empty(0, "i8")], [b""], None
    rows = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "ids", "other")), strict=True), key=lambda r: r[0])
    if [r[0] for r in rows] != np.flatnonzero(np.diff(at)).tolist():
        raise ValueError("buckets of a block's words and of their ids differ")
    for bucket, packed, other in rows:
        n, content = _unpack(packed)
        if len(n) != at[bucket + 1] - at[bucket]:
            raise ValueError("numbers of a bucket's words and of their ids differ")
        sizes.append(n // 4)
        flat.append(content)
        if other:
            texts = words.to_pylist() if texts is None else texts
            for k, text in enumerate(unpack_bytes(other), int(at[bucket])):
                if text:
                    texts[k] = text[1:]
    n, ids = np.concatenate(sizes), np.frombuffer(b"".join(flat), "<u4")
    each = pa.array([b"%d," % i for i in range(int(ids.max(initial=0)) + 1)], pa.large_binary()).take(pa.array(ids))
    starts = _ends(each)[np.append(0, np.cumsum(n))]
    decimal = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(starts), each.buffers()[2]])
    return n, decimal, words if texts is None else pa.array(texts, pa.large_binary())


def join_by_position(dealt: DataFrame, encoded: DataFrame, buckets: int, finish, schema: pa.Schema, ddl: str) -> DataFrame:
    """finish(n, ids, decoded) of every text: the number of its ids, the ids in decimal, each before a comma, and its bytes.

    The ids of a bucket stand in the order of the block's sorted words. A text's ids and bytes are those of its words
    in their order, taken for a run of texts at a time.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        found, sizes = _block_words(left)
        coded = found.dictionary_encode().chunks  # without those of runs that have no words
        words = coded[0].dictionary if coded else pa.array([b""], pa.large_binary())[:0]
        order, at = _vocabulary(words, buckets)
        n, decimal, decoded = _joined_ids(right, words.take(pa.array(order)), at)
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        places = place[np.concatenate([np.empty(0, "i4"), *(c.indices.to_numpy(zero_copy_only=False) for c in coded)]).astype("i4")]
        rows, done = [], 0
        for size in sizes:
            ends = np.append(0, np.cumsum(size))
            codes = places[done : done + ends[-1]]
            done += ends[-1]
            total, index = np.append(0, np.cumsum(n[codes]))[ends], pa.array(codes)
            cut = []
            for strings in (decimal.take(index), decoded.take(index)):
                data, e = memoryview(strings.buffers()[2] or b""), _ends(strings)[ends].tolist()
                cut.append([data[a:b] for a, b in zip(e, e[1:], strict=False)])
            rows += map(finish, np.diff(total).tolist(), *cut)
        cols = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([left.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return dealt.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(run, ddl)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _digest(n: int, ids: memoryview, decoded: memoryview) -> tuple:
    whole = str(decoded, "utf-8", "replace")
    return n, hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(whole.encode()).hexdigest()


def _ids(n: int, ids: memoryview, decoded: memoryview) -> tuple:
    return [int(i) for i in bytes(ids).split(b",")[:-1]], str(decoded, "utf-8", "replace")


def _run(docs: DataFrame, path: str | None, block_bytes: int, finish, schema, ddl) -> DataFrame:
    path = path or default_path()
    n = block_count(docs, block_bytes)
    buckets = bucket_count(docs.sparkSession, n)
    dealt = deal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], n)
    return join_by_position(dealt, encode_words(distinct_words(dealt, buckets), buckets, path), buckets, finish, schema, ddl)


def encode(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids array<int>, decoded text."""
    return _run(docs, path, block_bytes, _ids, _DECODED, "doc_id long, ids array<int>, decoded string")


def piece_table(spark, path: str | None = None) -> DataFrame:
    """id, piece (bytes) of the vocabulary: one row for each id, a fixed size."""
    return spark.createDataFrame(list(enumerate(map(bytearray, pieces(path or default_path())))), "id int, piece binary")


def decode(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids array<int>: ids joined to pieces, which are put together by position.

    The piece table is broadcast; it has one row for each id of the vocabulary and doesn't grow with the data.
    Unknown ids add nothing; null or empty ids give an empty text; repeated doc_ids stay apart.
    """
    rows = ids.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids")
    long = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = long.join(F.broadcast(piece_table(ids.sparkSession, path)), "id", "left")
    whole = joined.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.hex("piece"), F.lit("")).alias("h")))).alias("p"))
    return whole.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "utf-8").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _run(docs, None, BLOCK_BYTES, _digest, _DIGEST, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
