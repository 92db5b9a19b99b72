"""Helpers shared by the operators: the cluster's shared folder, staged tables, Arrow buffers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes are handled in slices of about this size, so that the working arrays stay in cache.
SLICE_BYTES = 1 << 21
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage durably."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # once written, nothing reads the shuffle files of this plan again
    try:
        df.write.option("compression", codec).parquet(at)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(at)
    out.staged_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no plan still to run reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """left join right on columns of which a few values may hold much of ``left``.

    ``counts`` (on, n) says how often left holds a key; keys may be left out if
    they are rare.  Keys with over a thousandth of all counted rows are dealt
    over as many salts, by the hash of ``by``, and their rows of ``right`` are
    repeated once a salt.  There are under 1000 such keys and 2000 repeats, so
    their table is broadcast.
    """
    spark = left.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(total // 1000, 64)
    hot = counts.where(F.col("n") > share).select(*on, (F.floor(F.col("n") / share) + 1).cast("long").alias("__salts")).collect()
    if not hot:
        return left.join(right, on, how)
    kind = counts.select(*on, F.lit(1).cast("long").alias("__salts")).schema
    hot = F.broadcast(spark.createDataFrame(hot, kind))
    left = left.join(hot, on, "left").withColumn("__salt", F.coalesce(F.expr(f"pmod(xxhash64({by}), __salts)"), F.lit(0))).drop("__salts")
    right = right.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of consecutive rows with about ``limit`` bytes of text; a longer text comes alone.

    Null texts count as empty.  The bytes are a view of the Arrow buffer.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, len(texts))
        yield ids.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function whose task gives its memory back to the system when it ends; workers are reused for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


# --- words -----------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: One random word per byte value; A-Z count as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_WORD = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
BYTE_EXACT = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if len(have) <= SLICE_BYTES + 4096:  # those for a longer text are not kept
            _powers[str(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; range_hash takes differences of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end], which depends on the bytes and their number only."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix), _BASE_INV)[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ([^\\x20\\x09-\\x0D]+, or the bytes that are not ``space``), and the number of words of each document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[:-1][offs[:-1] < offs[1:]]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut[1:] - 1] = inside[cut[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offs))


def word_hashes(data: np.ndarray, offs: np.ndarray, table: np.ndarray = BYTE_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of words of each document."""
    start, end, n = word_spans(data, offs)
    return range_hash(prefix_hash(data, table), start, end), n


def shingles(words: np.ndarray, n_words: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` words (shorter texts: of all their words) and their number by document."""
    total = len(words)
    prefix = np.zeros(total + 1, np.uint64)
    np.cumsum(words * powers(total) if total else words, out=prefix[1:])
    ends = np.cumsum(n_words)
    begin = ends - n_words
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    first = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    stop = np.minimum(first + width, np.repeat(ends, n))
    return range_hash(prefix, first, stop), n


# --- packed arrays ---------------------------------------------------------


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one byte string."""
    head = ";".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode()
    return b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(v).tobytes() for v in arrays.values())])


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    out, at = {}, 4 + n
    for part in bytes(blob[4 : 4 + n]).decode().split(";"):
        k, kind, m = part.split(":")
        out[k] = np.frombuffer(blob, kind, int(m), at)
        at += out[k].nbytes
    return out


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by bucket, and the bounds of each bucket in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))
