"""ISO media containers: box walk, sample tables, keyframe byte ranges; and a store for 8-bit samples.

Reading decodes the index boxes only, never the payload: `read_tracks` walks nested boxes, decodes the sample
tables with array arithmetic and gives codec, duration and the byte ranges of sync samples per track.
Sizes may be fixed, listed or compact; movie fragments add their runs of samples to their tracks. Edit lists and
composition times change neither byte ranges nor a track's duration and aren't read.
`media_columns` applies it to a binary column; `store_texts` writes texts as 8-bit PCM tracks.

Defined results: null or empty media, no movie box, and truncated or contradictory tables give zero tracks and
an `error` text, never an exception (no table is expanded before its counts fit into the file); null text is stored as 64 zero bytes; repeated rows give equal values; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Boxes whose payload is a list of boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"udta", b"moof", b"traf"))
MAX_DEPTH = 16
#: Stored texts: mono 8-bit samples at this rate, cut into chunks of so many samples; padded to BLOCK bytes.
RATE, CHUNK, BLOCK = 8000, 4096, 64


class MediaError(ValueError):
    pass


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    tables: dict = field(default_factory=dict)
    n_samples: int = 0
    number: int = 0
    #: Of movie fragments: (start, size, is sync) of their samples, as arrays, and their duration.
    fragments: list = field(default_factory=list)
    fragment_time: int = 0
    #: Merged [start, end) byte ranges of all samples and of sync samples.
    ranges: np.ndarray = field(default_factory=lambda: np.empty((0, 2), "i8"))
    keyframes: np.ndarray = field(default_factory=lambda: np.empty((0, 2), "i8"))


def boxes(buf: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, payload start, payload end) of the boxes in buf[start:end]."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", buf, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise MediaError("truncated box header")
            size, head = struct.unpack_from(">Q", buf, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise MediaError(f"box {kind!r} of {size} bytes exceeds its parent")
        yield kind, at + head, at + size
        at += size


def _table(buf: memoryview, start: int, end: int, kind: str, width: int) -> np.ndarray:
    """Entries of a full box: version and flags, count, then count records of `width` big-endian numbers."""
    n = struct.unpack_from(">I", buf, start + 4)[0]
    size = np.dtype(kind).itemsize * width
    if start + 8 + n * size > end:
        raise MediaError("table longer than its box")
    return np.frombuffer(buf, kind, n * width, start + 8).astype("i8").reshape(n, width)


@dataclass
class Fragment:
    """Where the samples of a movie fragment's tracks stand, and the defaults of each track (duration, size, flags)."""

    defaults: dict = field(default_factory=dict)
    begin: int = 0
    at: int = 0
    number: int = 0
    now: tuple = (0, 0, 0)

    def header(self, buf: memoryview, a: int) -> None:
        """A track's part begins."""
        flags, self.number = struct.unpack_from(">II", buf, a)
        a += 8
        duration, size, sample = self.defaults.get(self.number, (0, 0, 0))
        if flags & 0x1:
            self.at = struct.unpack_from(">Q", buf, a)[0]
            a += 8
        elif flags & 0x20000:
            self.at = self.begin
        self.base = self.at
        a += 4 * bool(flags & 0x2)
        if flags & 0x8:
            duration, a = struct.unpack_from(">I", buf, a)[0], a + 4
        if flags & 0x10:
            size, a = struct.unpack_from(">I", buf, a)[0], a + 4
        if flags & 0x20:
            sample = struct.unpack_from(">I", buf, a)[0]
        self.now = duration, size, sample

    def run(self, buf: memoryview, a: int, b: int, track: Track) -> None:
        """Samples that follow each other."""
        flags, n = struct.unpack_from(">II", buf, a)
        a += 8
        duration, size, sample = self.now
        if flags & 0x1:
            self.at, a = self.base + struct.unpack_from(">i", buf, a)[0], a + 4
        first = None
        if flags & 0x4:
            first, a = struct.unpack_from(">I", buf, a)[0], a + 4
        columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if a + 4 * n * len(columns) > b or n * max(size, 1) > len(buf) and 0x200 not in columns:
            raise MediaError("run of samples longer than its box or the file")
        table = np.frombuffer(buf, ">u4", n * len(columns), a).astype("i8").reshape(n, len(columns))
        sizes = table[:, columns.index(0x200)] if 0x200 in columns else np.full(n, size, "i8")
        kinds = table[:, columns.index(0x400)].copy() if 0x400 in columns else np.full(n, sample, "i8")
        if first is not None and n:
            kinds[0] = first
        track.fragments.append((self.at + np.cumsum(sizes) - sizes, sizes, kinds & 0x10000 == 0))
        track.fragment_time += int(table[:, columns.index(0x100)].sum()) if 0x100 in columns else n * duration
        self.at += int(sizes.sum())


def _walk(buf: memoryview, start: int, end: int, track: Track | None, found: list[Track], depth: int, part: Fragment) -> None:
    if depth > MAX_DEPTH:
        raise MediaError("boxes nested too deeply")
    before = start
    for kind, a, b in boxes(buf, start, end):
        if kind == b"moof":
            part.begin = part.at = before
        before = b
        if kind == b"trak":
            found.append(t := Track())
            _walk(buf, a, b, t, found, depth + 1, part)
        elif kind in CONTAINERS:
            _walk(buf, a, b, track, found, depth + 1, part)
        elif kind == b"trex":
            number, _, *defaults = struct.unpack_from(">5I", buf, a + 4)
            part.defaults[number] = tuple(defaults)
        elif kind == b"tfhd":
            part.header(buf, a)
        elif kind == b"trun":
            owner = next((t for t in found if t.number == part.number), None)
            if owner is None:
                raise MediaError("fragment of an unknown track")
            part.run(buf, a, b, owner)
        elif track is None:
            continue
        elif kind == b"mdhd":
            wide = buf[a] == 1
            track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", buf, a + (20 if wide else 12))
        elif kind == b"tkhd":
            track.number = struct.unpack_from(">I", buf, a + (20 if buf[a] == 1 else 12))[0]
            w, h = struct.unpack_from(">II", buf, b - 8)
            track.width, track.height = w >> 16, h >> 16
        elif kind == b"hdlr":
            track.handler = bytes(buf[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            track.codec = next((k.decode("latin-1") for k, _, _ in boxes(buf, a + 8, b)), "")
        elif kind == b"stts":
            track.tables["stts"] = _table(buf, a, b, ">u4", 2)
        elif kind == b"stsc":
            track.tables["stsc"] = _table(buf, a, b, ">u4", 3)
        elif kind == b"stss":
            track.tables["stss"] = _table(buf, a, b, ">u4", 1)[:, 0]
        elif kind in (b"stco", b"co64"):
            track.tables["chunks"] = _table(buf, a, b, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", buf, a + 4)
            if fixed:
                if fixed * n > len(buf):
                    raise MediaError("more samples than the file can hold")
                track.tables["stsz"] = (fixed, n)
            else:
                if a + 12 + 4 * n > b:
                    raise MediaError("table longer than its box")
                track.tables["stsz"] = (np.frombuffer(buf, ">u4", n, a + 12).astype("i8"), n)
        elif kind == b"stz2":
            bits, n = buf[a + 7], struct.unpack_from(">I", buf, a + 8)[0]
            if bits not in (4, 8, 16) or a + 12 + (n * bits + 7) // 8 > b:
                raise MediaError("bad compact sizes")
            if bits == 4:
                halves = np.frombuffer(buf, "u1", (n + 1) // 2, a + 12)
                sizes = np.stack([halves >> 4, halves & 15], 1).reshape(-1)[:n]
            else:
                sizes = np.frombuffer(buf, "u1" if bits == 8 else ">u2", n, a + 12)
            track.tables["stsz"] = (sizes.astype("i8"), n)


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Join ranges that follow each other without a gap, in the order given."""
    keep = end > start
    start, end = start[keep], end[keep]
    if not len(start):
        return np.empty((0, 2), "i8")
    new = np.r_[True, start[1:] != end[:-1]]
    return np.stack([start[new], end[np.r_[new[1:], True]]], 1)


def _resolve(t: Track, total: int) -> None:
    """Sample byte ranges from the sample-to-chunk, size and chunk offset tables."""
    if not {"stsc", "stsz", "chunks"} <= t.tables.keys():
        raise MediaError("sample tables missing")
    sizes, n = t.tables["stsz"]
    chunks, runs = t.tables["chunks"], t.tables["stsc"]
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > max(len(chunks), 1)):
        raise MediaError("sample-to-chunk table out of order")
    per = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1])) if len(runs) else np.zeros(len(chunks), "i8")
    if per.sum() != n:
        raise MediaError("sample counts disagree")
    if "stts" in t.tables and t.tables["stts"][:, 0].sum() != n:
        raise MediaError("time table disagrees with the sample count")
    first = np.cumsum(per) - per
    t.n_samples = int(n)
    sync = t.tables.get("stss")
    if sync is None and isinstance(sizes, int):
        ends = chunks + per * sizes
        t.ranges = t.keyframes = _merged(chunks, ends)
    else:
        each = np.full(n, sizes, "i8") if isinstance(sizes, int) else sizes
        before = np.cumsum(each) - each
        start = np.repeat(chunks - np.r_[before, each.sum() if n else 0][first], per) + before
        ends = start + each
        t.ranges = _merged(start, ends)
        if sync is None:
            t.keyframes = t.ranges
        else:
            if len(sync) and (sync.min() < 1 or sync.max() > n):
                raise MediaError("sync sample out of range")
            t.keyframes = _merged(start[sync - 1], ends[sync - 1])
    if t.fragments:
        start, size, sync = (np.concatenate(x) for x in zip(*t.fragments, strict=True))
        t.n_samples += len(start)
        t.duration = max(t.duration, t.fragment_time)
        t.ranges = np.concatenate([t.ranges, _merged(start, start + size)])
        t.keyframes = np.concatenate([t.keyframes, _merged(start[sync], (start + size)[sync])])
    if len(t.ranges) and (t.ranges.max() > total or t.ranges.min() < 0):
        raise MediaError("samples outside the file")


def read_tracks(data: bytes) -> list[Track]:
    """Tracks of a container; raises MediaError if its boxes or tables contradict each other."""
    buf = memoryview(data)
    found: list[Track] = []
    try:
        _walk(buf, 0, len(buf), None, found, 0, Fragment())
        for t in found:
            _resolve(t, len(buf))
    except (struct.error, IndexError, ValueError) as e:
        raise e if isinstance(e, MediaError) else MediaError(str(e)) from e
    return found


def read_payload(data: bytes, track: Track) -> bytes:
    """The bytes of all samples in order."""
    return b"".join(data[a:b] for a, b in track.ranges.tolist())


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_samples(payload: bytes, rate: int = RATE, chunk: int = CHUNK, wide: bool = False) -> bytes:
    """A container with one mono track of 8-bit samples; wide: 64-bit chunk offsets."""
    n = len(payload)
    full, rest = divmod(n, chunk)
    runs = ([(1, chunk, 1)] if full else []) + ([(full + 1, rest, 1)] if rest else [])
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16))

    def moov(base: int) -> bytes:
        offsets = (base + chunk * np.arange(full + bool(rest), dtype="i8")).astype(">u8" if wide else ">u4").tobytes()
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", 1, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", full + bool(rest)), offsets),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0")
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)), hdlr, minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _UNITY, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, rate, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + 8
    return b"".join((ftyp, moov(head), struct.pack(">I4s", 8 + n, b"mdat"), payload))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a container of 8-bit samples, zero-padded to 64 bytes."""

    def run(batches):
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            media = [write_samples(padded(t)) for t in texts]
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


COLUMNS = "tracks array<struct<handler:string,codec:string,width:int,height:int,seconds:double,samples:long,keyframes:array<struct<start:long,end:long>>>>, error string"


def describe(data: bytes | None) -> tuple[list[dict], str | None]:
    """Track rows of a container, or no rows and what is wrong with it."""
    if not data:
        return [], "no data"
    try:
        tracks = read_tracks(data)
    except MediaError as e:
        return [], str(e)
    rows = [
        {"handler": t.handler, "codec": t.codec, "width": t.width, "height": t.height, "seconds": t.duration / t.timescale if t.timescale else None, "samples": t.n_samples, "keyframes": [{"start": a, "end": z} for a, z in t.keyframes.tolist()]}
        for t in tracks
    ]
    return rows, None if rows else "no tracks"


def media_columns(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, tracks, error of a binary column; payloads aren't decoded."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        track = pa.struct([("handler", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for b in slices(batches, media):
            found = [describe(x) for x in b.column(media).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([x for x, _ in found], pa.list_(track)), pa.array([e for _, e in found], pa.string())], [key, "tracks", "error"])

    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, {COLUMNS}")


def payload_features(stored: DataFrame) -> DataFrame:
    """Read each stored container back: digests of payload and container, and a feature of its tables."""

    def one(data: bytes) -> tuple:
        t = read_tracks(data)[0]
        payload = read_payload(data, t)
        feature = f"{t.handler}/{t.codec.strip()};rate={t.timescale};samples={t.n_samples};seconds={t.duration / t.timescale:.6f};keyframes=" + ",".join(f"{a}-{z}" for a, z in t.keyframes.tolist())
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in slices(batches, "media"):
            rows = list(zip(*[one(x) for x in b.column("media").to_pylist()], strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]], ["doc_id", "n_bytes", *names])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    return payload_features(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
