"""Documents dealt into blocks of bounded size, and word hashes as arrays.

A block is a shard of documents with a hashed key, small enough for one task; tables keyed by the block bring
to it what the whole corpus says about its contents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices, total_bytes

BLOCK_BYTES = 8_000_000
_U = np.uint64


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """Blocks of about block_bytes of text, and enough for every shuffle partition."""
    return max(1, -(-total_bytes(docs, "text") // block_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket_count(spark, blocks: int) -> int:
    """Buckets of keys that blocks exchange: with the root of the blocks' number, so that neither the values of one
    bucket nor the number of values grows with its square."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * math.isqrt(blocks))


def deal(docs: DataFrame, columns: list[str], n: int) -> DataFrame:
    """block, columns, z (the whole text, zstd-compressed; null as empty), hash-partitioned by block.

    Blocks depend on the rows alone, so that a repeated task deals alike.
    """

    def run(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, "text"):
            z = [c.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), *[b.column(x) for x in columns], pa.array(z, pa.binary())], ["block", *columns, "z"])

    block = F.pmod(F.xxhash64(*columns, "text"), F.lit(n)).cast("int").alias("block")
    return docs.select(block, *columns, "text").mapInArrow(run, with_fields(docs, columns, "block int", "z binary")).repartition(n, "block")


def with_fields(df: DataFrame, columns: list[str], before: str, after: str) -> StructType:
    """A schema of df's columns, as they are, between other fields."""
    first, last = (StructType.fromDDL(x) if x else StructType() for x in (before, after))
    return StructType([*first.fields, *[df.schema[c] for c in columns], *last.fields])


def arrow_fields(df: DataFrame, columns: list[str]) -> list[tuple[str, pa.DataType]]:
    """Names and Arrow types of columns."""
    from pyspark.sql.pandas.types import to_arrow_type

    return [(c, to_arrow_type(df.schema[c].dataType)) for c in columns]


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of compressed texts."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(z) for z in column.to_pylist()]


def runs(texts: list[bytes], most: int = 4_000_000):
    """Runs of texts of about `most` bytes (always one text at least)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def words_in(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts in a row, and the number of words of each text."""
    ends = np.cumsum([0, *map(len, texts)], dtype="i8")
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(texts))]))
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at a text's ends leaves empty pieces
    counted = np.r_[0, np.cumsum(full)]
    at = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype("i8")
    return flat if full.all() else flat.filter(pa.array(full)), np.diff(counted[at])


#: Words up to so many bytes are hashed as arrays, eight bytes at a time.
_SHORT = 32
_MASKS = np.array([0, *[(1 << 8 * k) - 1 for k in range(1, 9)]], "u8")


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words (a large string array): a chain of mixed eight-byte pieces, for long ones xxh3."""
    ends = np.frombuffer(words.buffers()[1], "i8")[words.offset : words.offset + len(words) + 1]
    start, size = ends[:-1], np.diff(ends)
    raw = words.buffers()[2]
    data = np.concatenate([np.frombuffer(raw, "u1")[: ends[-1]] if raw else np.empty(0, "u1"), np.zeros(_SHORT + 8, "u1")])
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    h = mix(size.astype("u8") + _U(0x2545F4914F6CDD1D))
    for at in range(0, _SHORT, 8):
        more = np.flatnonzero(size > at)
        piece = eight[np.minimum(start[more] + at, len(eight) - 1)] & _MASKS[np.minimum(size[more] - at, 8)]
        h[more] = mix((h[more] ^ piece) * _U(0x9E3779B97F4A7C15) + _U(at + 1))
    for i in np.flatnonzero(size > _SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return h


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and the number of words of each text."""
    words, sizes = words_in(texts)
    known = words.dictionary_encode()
    return word_hashes(known.dictionary)[known.indices.to_numpy(zero_copy_only=False)], sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of k consecutive values from each place on (as many as fit), the same wherever they stand.

    A polynomial in `base`, put together from stretches of doubled length, and mixed.
    """
    if len(h) < k:
        return np.empty(0, "u8")
    out, have, part, width = None, 0, h, 1
    left = k
    while left:
        if left & 1:
            if out is None:
                out, have = part, width
            else:
                n = len(h) - have - width + 1
                out, have = part[:n] * _U(pow(base, have, 1 << 64)) + out[width : width + n], have + width
        left >>= 1
        if left:
            n = len(h) - 2 * width + 1
            part = part[:n] * _U(pow(base, width, 1 << 64)) + part[width : width + n]
            width *= 2
    return mix(out[: len(h) - k + 1])
