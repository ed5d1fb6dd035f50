"""Exact vector distances: short ones unroll into generated code, longer ones run over Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Dimensions up to which a fixed query vector is unrolled; beyond it generated code grows too long to compile.
UNROLL = 16


def _terms(v: Column, q: Sequence[float], f: Callable[[Column, Column], Column]) -> Column:
    return reduce(lambda a, b: a + b, [f(F.get(v, i).cast("double"), F.lit(float(x))) for i, x in enumerate(q)])


def _short(metric: str, v: Column, q: Sequence[float]) -> Column:
    dot = _terms(v, q, lambda a, b: a * b)
    if metric == "L2":
        return _terms(v, q, lambda a, b: (a - b) * (a - b))
    if metric == "IP":
        return -dot
    size = float(np.sqrt(np.dot(q, q)))
    own = F.sqrt(_terms(v, q, lambda a, b: a * a))
    cos = F.when((own > 0) & F.lit(size > 0), dot / F.when(own > 0, own * F.lit(size or 1.0)))
    return F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))


def _long(metric: str, q: Sequence[float]):
    q = np.asarray(q, np.float64)

    @F.arrow_udf(DoubleType())
    def run(vectors: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        out, fine = np.zeros(len(vectors)), size == len(q)
        if fine.any():
            flat = vectors.filter(pa.array(fine)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))  # null parts become NaN
            if metric == "L2":
                d = ((x - q) ** 2).sum(1)
            elif metric == "IP":
                d = -(x @ q)
            else:
                norm = np.sqrt((x * x).sum(1) * (q @ q))
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = 1 - np.clip(np.where(norm > 0, x @ q / norm, np.nan), -1, 1)
            out[fine] = d
        return pa.array(out, mask=~fine | np.isnan(out))

    return run


def distance(metric: str, v: Column, q: Sequence[float]) -> Column:
    """Distance by L2 (squared), IP (negative product) or COSINE (1 - cosine).

    Null for vectors of another length or with null parts, and by COSINE for zero vectors.
    """
    metric = metric.upper()
    if metric not in ("L2", "IP", "COSINE"):
        raise ValueError(f"unknown metric {metric}")
    return F.when(F.size(v) == len(q), _short(metric, v, q)) if len(q) <= UNROLL else _long(metric, q)(v)


def similarity(d: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / 2))


def quantised(v: Column) -> Column:
    """Symmetric 8-bit code of a vector: scale and integers."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(most > 0, most / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("code"))


def sign_bits(v: Column) -> Column:
    """Binary code: one boolean a dimension."""
    return F.transform(v, lambda x: x > 0)
