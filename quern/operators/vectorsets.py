"""Vector sets as (key, id, vector, attrs) rows: exact similarity search with attribute filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.values import to_number
from quern.functions.vectors import distance, similarity

_CLAUSE = re.compile(r"""\s*\.?(\w+)\s*(==|!=|>=|<=|>|<|\bin\b)\s*(\((?:[^()]*)\)|\[[^\]]*\]|"[^"]*"|'[^']*'|[^\s&]+)\s*""", re.IGNORECASE)


def _literal(text: str) -> tuple[str, float | None]:
    s = text[1:-1] if text[:1] in "\"'" else text
    try:
        return s, None if text[:1] in "\"'" else float(s)
    except ValueError:
        return s, None


def _clause(text: Column, number: Column, op: str, raw: str) -> Column:
    s, x = _literal(raw.strip())
    if op in ("==", "!="):
        same = (text == s) if x is None else F.coalesce(number == x, F.lit(False)) | (text == s)
        if x is None and s in ("true", "false"):
            same = same | (number == (1.0 if s == "true" else 0.0))
        return same if op == "==" else ~same
    left, right = (number, x) if x is not None else (text, s)
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def attribute_filter(attrs: Column, expression: str) -> Column:
    """Clauses joined by AND or &&: ==, !=, >, >=, <, <=, IN (...). A missing attribute fails every clause."""
    held, at = F.lit(True), 0
    while at < len(expression):
        m = _CLAUSE.match(expression, at)
        if not m:
            raise ValueError(f"cannot read {expression[at:]!r}")
        text = F.get_json_object(attrs, f"$.{m[1]}")
        number = to_number(F.when(text == "true", "1").when(text == "false", "0").otherwise(text))

        op = m[2].lower()
        if op == "in":
            any_of = F.lit(False)
            for part in m[3][1:-1].split(","):
                any_of = any_of | F.coalesce(_clause(text, number, "==", part), F.lit(False))
            held = held & any_of & text.isNotNull()
        else:
            held = held & F.coalesce(_clause(text, number, op, m[3]), F.lit(False)) & text.isNotNull()
        at = m.end()
        joint = re.match(r"(&&|and\b)", expression[at:], re.IGNORECASE)
        if joint:
            at += joint.end()
        elif expression[at:].strip():
            raise ValueError(f"cannot read {expression[at:]!r}")
    return held


def embedding(vectors: DataFrame, key: str, element: str) -> list[float]:
    found = vectors.where((F.col("key") == key) & (F.col("id") == element)).select("vector").first()
    if found is None:
        raise KeyError(element)
    return list(found["vector"])


def similar(vectors: DataFrame, key: str, query: Sequence[float], count: int = 10, where: str | None = None, epsilon: float | None = None, metric: str = "COSINE") -> DataFrame:
    """id, score (1 best, 0 worst), nearest first: an exact top-k."""
    own = vectors.where(F.col("key") == key)
    if where:
        own = own.where(attribute_filter(F.col("attrs"), where))
    near = own.select("id", distance(metric, F.col("vector"), query).alias("distance")).where("distance is not null").orderBy("distance", "id").limit(count)
    out = near.select("id", similarity(F.col("distance")).alias("score"), "distance")
    return out if epsilon is None else out.where(F.col("score") >= 1 - epsilon)


def within(vectors: DataFrame, key: str, query: Sequence[float], radius: float, metric: str = "COSINE") -> DataFrame:
    own = vectors.where(F.col("key") == key).select("id", distance(metric, F.col("vector"), query).alias("distance"))
    return own.where(F.col("distance") <= radius)


def add(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert (key, id, vector, attrs[, seq])."""
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    new = rows.groupBy("key", "id").agg(F.max_by(F.struct("vector", "attrs"), seq).alias("x")).select("key", "id", "x.*")
    return vectors.join(new, ["key", "id"], "left_anti").select("key", "id", "vector", "attrs").unionByName(new)


def remove(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    return vectors.join(rows.select("key", "id").distinct(), ["key", "id"], "left_anti")


def info(vectors: DataFrame) -> DataFrame:
    """Per key: cardinality and dimension."""
    return vectors.groupBy("key").agg(F.count(F.lit(1)).alias("card"), F.max(F.size("vector")).alias("dim"))


def is_member(vectors: DataFrame, key: str, element: str) -> DataFrame:
    return vectors.agg(F.coalesce(F.max(((F.col("key") == key) & (F.col("id") == element)).cast("int")), F.lit(0)).alias("found"))


def set_attributes(vectors: DataFrame, key: str, element: str, attrs: str | None) -> DataFrame:
    mine = (F.col("key") == key) & (F.col("id") == element)
    return vectors.withColumn("attrs", F.when(mine, F.lit(attrs or None).cast("string")).otherwise(F.col("attrs")))


def id_range(vectors: DataFrame, key: str, start: str, end: str, count: int = 10) -> DataFrame:
    """Ids in a lexicographic range: [ includes, ( excludes, - and + are open ends."""
    c, held = F.col("id"), F.col("key") == key
    if start != "-":
        held = held & (c >= start[1:] if start[0] == "[" else c > start[1:])
    if end != "+":
        held = held & (c <= end[1:] if end[0] == "[" else c < end[1:])
    return vectors.where(held).select("id").orderBy("id").limit(count)


def random_members(vectors: DataFrame, key: str, count: int = 1, seed: int = 0) -> DataFrame:
    return vectors.where(F.col("key") == key).orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(abs(count)).select("id")


def neighbours(vectors: DataFrame, key: str, element: str, count: int = 16) -> DataFrame:
    """Exact nearest neighbours, where a graph index would show its links."""
    return similar(vectors, key, embedding(vectors, key, element), count + 1).where(F.col("id") != element).limit(count)


def projected(vectors: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """Random projection to ``dim`` numbers by signs of a keyed hash, scaled by 1 / sqrt(dim)."""

    def signs(n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = np.uint64(seed) ^ (np.arange(n, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(dim, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.where(z >> np.uint64(63), -1.0, 1.0) / np.sqrt(dim)

    @F.pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        known: dict[int, np.ndarray] = {}
        return v.map(lambda x: None if x is None else (np.asarray(x, float) @ known.setdefault(len(x), signs(len(x)))).astype(np.float32).tolist())

    return vectors.withColumn("vector", run("vector"))
