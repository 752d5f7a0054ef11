"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: space and tab to carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes after which a batch for Python ends in steps that gain nothing from larger ones, as Spark and the worker each hold a batch whole.
SMALL_BATCH = 2 << 20
_PRIME = 0x9E3779B97F4A7C15 | 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def small_batches(spark: SparkSession):
    """Batches for Python of SMALL_BATCH bytes in what is run inside."""
    return _setting(spark, _BATCH_BYTES, str(SMALL_BATCH))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage at a table that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Shuffle files go as soon as the table is written: nothing reads them again.
    with _setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_stage_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: the fixed folds of the contracts. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column as one array without copying, and the n + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    bufs = column.buffers()
    n, at = len(column), column.offset
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _byte_codes(seed: int) -> np.ndarray:
    codes = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return codes[LOWER]


_CODES = _byte_codes(42)
_BLOCK = 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse modulo 2**64, 0 to n - 1."""
    def run(base: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        out[1:] = np.uint64(base)
        return np.multiply.accumulate(out)
    return run(_PRIME), run(pow(_PRIME, -1, 2**64))


_POW, _INV = _powers(_BLOCK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the lower-cased (A-Z) words of all texts in order, and the n + 1 word offsets of the texts; then
    hashes of each word's first bytes, for every number in prefixes. A number below zero stands for the last bytes.

    The hash is a polynomial over random byte codes modulo 2**64, taken from prefix sums, so that no word passes
    through Python."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    word = ~IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:n]
    starts = np.flatnonzero(starts)
    ends = word
    ends[:-1] &= ~word[1:] | first[1:n]
    ends = np.flatnonzero(ends) + 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    hashes = np.empty(len(starts), np.uint64)
    heads = [np.empty(len(starts), np.uint64) for _ in prefixes]
    # Prefix sums restart at every block of words, so the powers stay in one small table; a longer word is hashed alone.
    w = 0
    while w < len(starts):
        lo = starts[w]
        e = int(np.searchsorted(ends, lo + _BLOCK, side="right"))
        if e <= w:
            h = 0
            for a in range(lo, ends[w], _BLOCK):
                part = _CODES[data[a : min(ends[w], a + _BLOCK)]]
                h = (h * 0xC2B2AE3D27D4EB4F + int((part * _POW[: len(part)]).sum(dtype=np.uint64)) + 1) % 2**64
            hashes[w] = h
            for k, head in zip(prefixes, heads):
                part = _CODES[data[lo : lo + k] if k > 0 else data[ends[w] + k : ends[w]]]
                head[w] = (part * _POW[: len(part)]).sum(dtype=np.uint64)
            w += 1
            continue
        hi = ends[e - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_CODES[data[lo:hi]] * _POW[: hi - lo], out=sums[1:])
        s = starts[w:e] - lo
        hashes[w:e] = (sums[ends[w:e] - lo] - sums[s]) * _INV[s]
        for k, head in zip(prefixes, heads):
            a, b = (s, np.minimum(ends[w:e] - lo, s + k)) if k > 0 else (np.maximum(s, ends[w:e] - lo + k), ends[w:e] - lo)
            head[w:e] = (sums[b] - sums[a]) * _INV[a]
        w = e
    return mix(hashes), np.searchsorted(starts, offsets), *(mix(h ^ np.uint64(k % 256)) for k, h in zip(prefixes, heads))


_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What tasks of one step keep in their Python worker for the next ones, until tasks of another step run there."""
    return _CACHES.setdefault(name, {})


def tidy(keep: str = "") -> None:
    """Drop what other steps' tasks have left in this Python worker: their caches, and memory they freed that the system hasn't got back."""
    stale = [cache for name, cache in _CACHES.items() if name != keep and cache]
    for cache in stale:
        cache.clear()
    if stale:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def batches_of(it: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts take about limit bytes at most (one row at least), so that memory stays bounded.
    keep: the name of the step's own worker_cache; others are emptied."""
    tidy(keep)
    for batch in it:
        if batch.num_rows == 0:
            continue
        _, off = byte_views(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
