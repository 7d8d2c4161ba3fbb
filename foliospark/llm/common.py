"""Helpers shared by the operators: shared storage, text batches, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that the vectorised parts hold at once.
SLICE_BYTES = 2 << 20
#: bytes of a batch between the JVM and Python
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temp folder only for local masters without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="foliospark-"))
    return spark.conf.get("spark.checkpoint.dir")


#: tables that this driver has written to the shared folder
_written: list[str] = []


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that materialise() wrote. Call it once the results that read them have been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


#: whether Spark deletes the shuffle files of a query once it has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str, once: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Results are lazy and read these tables, so they stay until drop_tables().
    once: what the write has shuffled goes at its end, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    before = spark.conf.get(_CLEANUP, None)
    try:
        if once:
            spark.conf.set(_CLEANUP, True)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if once:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, tag: str) -> DataFrame:
    """df with a number of each row, _row, written once so that every later pass gives a row the same number."""
    return materialise(df.withColumn("_row", F.monotonically_increasing_id()), tag)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of at most 8 MB, whatever the length of texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(f, schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _give_back() -> None:
    """Return freed memory to the system: workers are kept for later stages, beside a growing JVM."""
    for powers in (_BYTES, *_GRAMS):
        powers.drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `most` bytes of text or a single row."""
    try:
        yield from _slices(batches, column, most)
    finally:
        _give_back()


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), 1))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word: maximal runs of bytes b with is_word[b] within one text.

    is_word must hold for all bytes from 0x80, so that runs of bytes are runs of characters.
    """
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, e
    w = is_word[buf]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    start[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for since they were last dropped."""

    def __init__(self, base: int):
        self.base = base
        self.drop()

    def drop(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._row(x, max(n, 2 * len(self.up), 1 << 16)) for x in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _row(x: int, n: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)


_BYTES, _GRAMS = Powers(0x9E3779B97F4A7C15), (Powers(0xD6E8FEB86659FD95), Powers(0xC2B2AE3D27D4EB4D))
#: bytes that word_hashes() sums up at once
_SUM_BYTES = 1 << 18
#: characters that char_hashes() looks at at once
_SUM_CHARS = 1 << 17


def _sums(x: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up, out=out[1:])
    return out


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word buf[s:e]; the words are disjoint and in order. Not keyed to any run: equal everywhere.

    A polynomial of the bytes, from differences of running sums.
    """
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        first = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, first + _SUM_BYTES, side="right")))
        x = _BYTE[buf[first : int(e[j - 1])]]
        up, down = _BYTES(len(x))
        sums = _sums(x, up)
        a, b = s[i:j] - first, e[i:j] - first
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def char_hashes(c: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of characters c[start : start + size]; no run is empty. A block of runs at a time, so that little is held beside c."""
    out, ends, i = np.empty(len(start), np.uint64), np.cumsum(size), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(ends, int(ends[i - 1] if i else 0) + _SUM_CHARS, side="right")))
        n = size[i:j]
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        x = c[np.repeat(start[i:j], n) + place].astype(np.uint64) + np.uint64(1)
        out[i:j] = np.add.reduceat(mix(x * _PLACE[place & 4095] + (place >> 12).astype(np.uint64)), at)
        i = j
    return out


def run_hashes(h: np.ndarray, start: np.ndarray, size: np.ndarray | int, salt: int = 0) -> np.ndarray:
    """Hash of each run of values h[start : start + size]."""
    up, down = _GRAMS[salt](max(len(h), 1))
    sums = _sums(h, up[: len(h)])
    return mix((sums[start + size] - sums[start]) * down[start])


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; len(h) - k + 1 of them (none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _GRAMS[0](len(h))
    sums = _sums(h, up)
    return mix((sums[k:] - sums[:-k]) * down[:n])


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """gram_hashes of each row, as a whole."""
    return mix((rows * _GRAMS[0](rows.shape[1])[0]).sum(axis=1, dtype=np.uint64))


def first_minima(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each `width` consecutive values, the first of equals; by doubling."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place, span = g, np.arange(len(g)), 1
    while span < width:
        by = min(span, width - span)
        m = len(least) - by
        less = least[by:] < least[:m]
        least, place = np.where(less, least[by:], least[:m]), np.where(less, place[by:], place[:m])
        span += by
    return place


def sieve(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit set of fixed size: bit (top `bits` bits of the key) for each key. At most 2**bits / 64 numbers reach the driver."""
    top = F.shiftrightunsigned(F.col(column), 64 - bits)
    words_ = keys.select(top.alias("b")).select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    got = words_.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
    return out


def in_sieve(bits: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    b = (keys.view(np.uint64) >> np.uint64(64 - size)).astype(np.int64)
    return (bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) > 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 up, or of doubles, as planes of bytes (no more of them than the largest number has), compressed."""
    head, planes = [], []
    for a in arrays:
        x = np.ascontiguousarray(a, np.float64 if a.dtype.kind == "f" else np.int64).view(np.uint64)
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head += [len(x), width]
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T))
    raw = b"".join(x.tobytes() for x in planes)
    return np.array([len(raw), len(arrays), *head], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of pack(), as int64; view() gives doubles back."""
    size, n = np.frombuffer(blob, np.int64, 2).tolist()
    head = np.frombuffer(blob, np.int64, 2 * n, 16).reshape(-1, 2).tolist()
    raw = np.frombuffer(pa.decompress(memoryview(blob)[16 + 16 * n :], size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for rows, width in head:
        x = np.zeros((rows, 8), np.uint8)
        x[:, :width] = raw[at : at + rows * width].reshape(width, rows).T
        out.append(x.reshape(-1).view(np.int64))
        at += rows * width
    return out


def crc_fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))
