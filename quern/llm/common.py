"""Shared helpers: scratch storage, word splitting over Arrow buffers, hashing.

Words are the maximal runs of bytes other than space and ``\\t\\n\\v\\f\\r`` of the
UTF-8 text.  All vectorised code here works on whole texts; callers bound memory
by handing over blocks of whole documents (``text_blocks``).
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time by the vectorised kernels.
BLOCK_BYTES = 2 << 20

WORD_PATTERN = "[^ \\t-\\r]+"

_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_OWN_SCRATCH: dict[str, str] = {}
_LIBC = ctypes.CDLL(None)


#: Arrow batches that feed the kernels: rows of long texts must not fill a worker.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch where the session has Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10_000:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        return spark.conf.get("spark.sql.warehouse.dir")  # executors on other machines do not see a folder of this one
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = tempfile.mkdtemp(prefix="quern-scratch-")
        atexit.register(shutil.rmtree, _OWN_SCRATCH[app], ignore_errors=True)
    return f"file://{_OWN_SCRATCH[app]}"


_MADE: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    """When the program ends, so do the folders of its operator calls, where the session still can."""
    for spark, base in _MADE:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, base)
            except (Py4JError, OSError):
                return  # the JVM has gone first


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def no_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished write are of no more use."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Written intermediate tables of one operator call.

    A table cuts lineage: a lost executor costs a reread, not a recompute.
    ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.base = f"{scratch_root(spark)}/quern-{uuid.uuid4().hex}"
        _MADE.append((spark, self.base))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with no_shuffle_files(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.base}/{name}")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; used only to size partitions, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that no input column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def every(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def powers(n: int, base: np.uint64 = _P) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(int(base), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offset of each (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_binary()).fill_null(b"")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """Words of a block of texts.

    buf: bytes in which one space follows each word but the last of a text;
    start, end: of each word in buf; ptr: words of text d are ptr[d]:ptr[d+1].
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        ws = _WS[data]
        first = np.zeros(len(data) + 1, bool)
        first[off[:-1]] = True  # an empty text marks the next text's first byte, which is one anyway
        first = first[: len(data)]
        before = np.empty_like(ws)
        before[:1] = True
        before[1:] = ws[:-1]
        before |= first
        keep = ~(ws & before)
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        off = at[off]
        self.buf = np.where(ws, np.uint8(32), data)[keep]
        ws, first, before = ws[keep], first[keep], None
        first = np.zeros(len(self.buf) + 1, bool)
        first[off] = True
        word = ~ws
        begins = word.copy()
        begins[1:] &= ws[:-1] | first[1:-1]
        ends = word
        ends[:-1] &= ws[1:] | first[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.ptr = np.searchsorted(self.start, off)

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        return cls(*flat(texts))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), np.uint64)
        step = 1 << 16
        for lo in range(0, len(self.start), step):  # bounded temporaries: blocks of words, not of the buffer
            s, e = self.start[lo : lo + step], self.end[lo : lo + step]
            if len(s) == 0:
                break
            base = s[0]
            part = self.buf[base : e[-1]]
            up, down = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            out[lo : lo + step] = (total[e - base] - total[s - base]) * down[s - base]
        return mix(out)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) of the n-word windows that stay in one text, and their hashes."""
        left = np.repeat(self.ptr[1:], np.diff(self.ptr)) - np.arange(len(h))
        at = np.flatnonzero(left >= n)
        return at, gram_hashes(h, n)[at] if len(at) else np.zeros(0, np.uint64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] at each i <= len(h) - n, padded with zeros."""
    out = np.zeros(len(h), np.uint64)
    step = max(1 << 16, n)
    for lo in range(0, len(h) - n + 1, step):  # bounded tables of powers
        part = h[lo : lo + step + n - 1]
        up, down = powers(len(part) + 1, _Q)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=total[1:])
        m = len(part) - n + 1
        out[lo : lo + m] = mix((total[n:] - total[:m]) * down[:m])
    return out


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup batches into tables of about ``limit`` bytes of text; a longer text stands alone."""
    try:
        yield from _blocks(batches, column, limit)
    finally:  # workers stay for later tasks, but not what this one has freed
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)


def _blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        lo = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                if i > lo:
                    held.append(batch.slice(lo, i - lo))
                yield pa.Table.from_batches(held)
                held, size, lo = [], 0, i
            size += int(n)
        held.append(batch.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of v[i:i+w] at each i <= len(v) - w."""
    out, have = v, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        n = len(v) - w + 1
        out = np.minimum(out[:n], out[w - have : w - have + n])
    return out
