"""HyperLogLog with 2^14 registers: 64-bit Murmur hashes and the improved raw estimator (Ertl 2017).

Registers are a mergeable aggregation, (key, register, rank) rows under max, so no element
set is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 14
REGISTERS = 1 << PRECISION
_RANKS = 64 - PRECISION
#: Fixed values of the hash: seed, multiplier and shift.
_SEED, _M, _R = 0xADC83B19, 0xC6A4A7935BD1E995, np.uint64(47)


def murmur64a(values: list[bytes]) -> np.ndarray:
    """MurmurHash64A of each value; values of one length are hashed together."""
    out, m = np.empty(len(values), np.uint64), np.uint64(_M)
    size = np.array([len(v) for v in values], np.int64)
    with np.errstate(over="ignore"):
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            raw = np.frombuffer(b"".join(values[i] for i in at.tolist()), np.uint8).reshape(len(at), n)
            h = np.full(len(at), _SEED ^ (n * _M & (1 << 64) - 1), np.uint64)
            whole = n // 8 * 8
            for k in np.ascontiguousarray(raw[:, :whole]).view("<u8").T if whole else ():
                k = k * m
                k ^= k >> _R
                h = (h ^ k * m) * m
            if n % 8:
                tail = np.zeros((len(at), 8), np.uint8)
                tail[:, : n % 8] = raw[:, whole:]
                h = (h ^ tail.view("<u8")[:, 0]) * m
            h ^= h >> _R
            h = h * m
            out[at] = h ^ (h >> _R)
    return out


def _registers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        distinct = batch.column("element").dictionary_encode()
        h = murmur64a(distinct.dictionary.to_pylist())
        rest = (h >> np.uint64(PRECISION)) | np.uint64(1 << _RANKS)
        rank = np.log2((rest & (~rest + np.uint64(1))).astype(np.float64)).astype(np.int64) + 1
        at = distinct.indices.to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array((h & np.uint64(REGISTERS - 1)).astype(np.int64)[at]), pa.array(rank[at])], names=["key", "register", "rank"])


def registers(rows: DataFrame) -> DataFrame:
    """(key, element) to the registers of each key's sketch: (key, register, rank)."""
    clean = rows.where("element is not null").select(F.col("key").cast("string").alias("key"), F.col("element").cast("string").cast("binary").alias("element"))
    return merged(clean.mapInArrow(_registers, "key string, register long, rank long"))


def merged(sketches: DataFrame) -> DataFrame:
    """Register-wise maximum; union rows of several keys under one key first to merge them."""
    return sketches.groupBy("key", "register").agg(F.max("rank").alias("rank"))


def _estimate(counts: np.ndarray) -> int:
    m, q = float(REGISTERS), _RANKS
    x = 1 - counts[q + 1] / m
    if x in (0.0, 1.0):
        tau = 0.0
    else:
        y, z = 1.0, 1 - x
        while True:
            x, before = np.sqrt(x), z
            y *= 0.5
            z -= (1 - x) ** 2 * y
            if before == z:
                break
        tau = z / 3
    z = m * tau
    for k in range(q, 0, -1):
        z = 0.5 * (z + counts[k])
    x = counts[0] / m
    if x == 1.0:
        return 0
    y, sigma = 1.0, x
    while True:
        x *= x
        before = sigma
        sigma += x * y
        y += y
        if before == sigma:
            break
    return int(np.rint(0.5 / np.log(2) * m * m / (z + m * sigma)))


def estimates(sketches: DataFrame) -> DataFrame:
    """(key, estimate): from the histogram of ranks, 52 numbers a key."""
    histogram = sketches.groupBy("key", "rank").agg(F.count(F.lit(1)).alias("n"))
    bins = histogram.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "n"))).alias("bins"))

    @F.pandas_udf("long")
    def estimate(s: pd.Series) -> pd.Series:
        out = []
        for entry in s:
            c = np.zeros(_RANKS + 2)
            for k, n in dict(entry).items():
                c[int(k)] = n
            c[0] = REGISTERS - c.sum()
            out.append(_estimate(c))
        return pd.Series(out, dtype="int64")

    return bins.select("key", estimate("bins").alias("estimate"))


def sketch(element: Column) -> Column:
    """The built-in sketch of the same precision, for use inside aggregations."""
    return F.hll_sketch_agg(element, F.lit(PRECISION))
