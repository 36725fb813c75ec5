"""Shared folder handling and small helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of writing after which shuffle files that nothing refers to are freed: large writes free theirs at once.
FREE_AFTER = 3.0
#: ASCII white space as the contracts of this package mean it: 0x20 and 0x09-0x0D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarmac-")
        spark.sparkContext.setCheckpointDir(root)
        return jsc.getCheckpointDir().get()
    return root


class Workspace:
    """Intermediate tables of one operator run, written to the shared folder.

    A written table cuts the lineage: a lost executor costs its own tasks only. Results read their last tables
    when they are used, so what isn't dropped before stays until the driver ends, which removes the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n, self.spent = 0, 0.0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df once and read it back; shuffle files of what is no longer referenced are freed."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        began = time.monotonic()
        df.write.option("compression", "zstd").parquet(path)
        self.spent += time.monotonic() - began
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tarmac_path = path
        del df
        if self.spent > FREE_AFTER:
            self.free()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._tarmac_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def free(self) -> None:
        """Let Spark's cleaner see what is no longer referenced; a full collection costs as much as a small job."""
        self.spent = 0.0
        gc.collect()
        self.spark._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(c: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` as an array; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WHITE_RUN), "")


def let(value: Column, body) -> Column:
    """Bind value once inside an expression: body gets it as a lambda variable, so it isn't evaluated again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `most` bytes of the text column (always one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > most or i - start >= rows):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield b.slice(start)


def trim() -> None:
    """Give memory that a task of a reused Python worker no longer needs back to the system."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a string column over the whole table (one narrow aggregate)."""
    return df.agg(F.sum(F.octet_length(column))).head()[0] or 0
