"""Hashes as (key, field, value[, expire_at]) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.keys import glob


def put(hashes: DataFrame, rows: DataFrame, mode: str = "") -> DataFrame:
    """Upsert (key, field, value[, seq]); NX keeps what is there, XX changes only what is there."""
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    new = rows.groupBy("key", "field").agg((F.min_by("value", seq) if mode == "NX" else F.max_by("value", seq)).alias("new"))
    both = hashes.select("key", "field", F.col("value").alias("old"), F.lit(True).alias("have")).join(new.withColumn("come", F.lit(True)), ["key", "field"], "full_outer")
    if mode == "XX":
        both = both.where("have")
    value = F.when(F.col("have") & F.lit(mode == "NX"), F.col("old")).when(F.col("come"), F.col("new")).otherwise(F.col("old"))
    return both.select("key", "field", value.alias("value"))


def get(hashes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row a field asked for, in order."""
    asked = hashes.sparkSession.createDataFrame(list(enumerate(fields)), "ordinal int, field string")
    own = hashes.where((F.col("key") == key) & F.col("field").isin(list(fields))).select("field", "value")
    return asked.join(own, "field", "left").select("ordinal", "field", "value").orderBy("ordinal")


def get_all(hashes: DataFrame, key: str) -> DataFrame:
    return hashes.where(F.col("key") == key).select("field", "value")


def remove(hashes: DataFrame, rows: DataFrame) -> DataFrame:
    return hashes.join(rows.select("key", "field").distinct(), ["key", "field"], "left_anti")


def exists(hashes: DataFrame, key: str, field: str) -> DataFrame:
    return hashes.agg(F.coalesce(F.max(((F.col("key") == key) & (F.col("field") == field)).cast("int")), F.lit(0)).alias("found"))


def lengths(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count(F.lit(1)).alias("fields"))


def value_lengths(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", "field", F.octet_length("value").alias("length"))


def as_map(hashes: DataFrame) -> DataFrame:
    """One row a key with all fields as a map: for keys of bounded size."""
    return hashes.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def increment(hashes: DataFrame, rows: DataFrame) -> DataFrame:
    """Add whole-number deltas (key, field, delta); a value that is none, or an overflow, is an error."""
    old = hashes.select("key", "field", "value")
    deltas = rows.groupBy("key", "field").agg(F.sum(F.col("delta").cast("bigint")).alias("delta"))
    both = old.join(deltas, ["key", "field"], "full_outer")
    number = F.coalesce(F.col("value"), F.lit("0")).try_cast("bigint")
    total = F.when(number.isNull(), F.raise_error(F.lit("hash value is not an integer"))).otherwise(F.coalesce(F.try_add(number, F.col("delta")), F.raise_error(F.lit("increment would overflow")).cast("bigint")))
    return both.select("key", "field", F.when(F.col("delta").isNull(), F.col("value")).otherwise(total.cast("string")).alias("value"))


def increment_float(hashes: DataFrame, rows: DataFrame) -> DataFrame:
    deltas = rows.groupBy("key", "field").agg(F.sum(F.col("delta").cast("double")).alias("delta"))
    both = hashes.select("key", "field", "value").join(deltas, ["key", "field"], "full_outer")
    total = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) + F.col("delta")
    return both.select("key", "field", F.when(F.col("delta").isNull(), F.col("value")).otherwise(total.cast("string")).alias("value"))


def random_fields(hashes: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    own = hashes.where(F.col("key") == key)
    return own.orderBy(F.xxhash64(F.lit(seed), F.col("field")), "field").limit(abs(count)).select("field", "value")


def scan(hashes: DataFrame, key: str, after: str | None = None, match: str | None = None, count: int = 10) -> DataFrame:
    own = hashes.where(F.col("key") == key).select("field", "value")
    page = (own if after is None else own.where(F.col("field") > F.lit(after))).orderBy("field").limit(count)
    return page.where(glob(F.col("field"), match)) if match else page


def _may(mode: str, at: Column) -> Column:
    old = F.col("expire_at")
    return {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (at > old), "LT": old.isNull() | (at < old)}[mode]


def expire(hashes: DataFrame, key: str, fields: Sequence[str], at, mode: str = "", now=None) -> DataFrame:
    """Set the expiry of fields; a time that is past deletes them. Conditions as for keys."""
    at = F.lit(at).cast("timestamp")
    mine = (F.col("key") == key) & F.col("field").isin(list(fields)) & F.coalesce(_may(mode, at), F.lit(False))
    out = hashes.withColumn("expire_at", F.when(mine, at).otherwise(F.col("expire_at")))
    return out if now is None else out.where(F.col("expire_at").isNull() | (F.col("expire_at") > F.lit(now).cast("timestamp")))


def persist(hashes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    mine = (F.col("key") == key) & F.col("field").isin(list(fields))
    return hashes.withColumn("expire_at", F.when(mine, F.lit(None).cast("timestamp")).otherwise(F.col("expire_at")))


def ttl(hashes: DataFrame, key: str, fields: Sequence[str], now, milliseconds: bool = False) -> DataFrame:
    """Remaining time of each field: -1 without expiry, -2 if missing."""
    asked = hashes.sparkSession.createDataFrame(list(enumerate(fields)), "ordinal int, field string")
    own = hashes.where(F.col("key") == key).select("field", "expire_at", F.lit(True).alias("have"))
    left = (F.unix_millis("expire_at") - F.unix_millis(F.lit(now).cast("timestamp")))
    left = left if milliseconds else F.ceil(left / 1000)
    out = asked.join(own, "field", "left")
    return out.select("ordinal", "field", F.when(F.col("have").isNull(), F.lit(-2)).when(F.col("expire_at").isNull(), F.lit(-1)).otherwise(left).cast("bigint").alias("ttl")).orderBy("ordinal")
