"""The keyspace as a catalog of (key, type, expire_at[, db]) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.keys import glob


def exists(catalog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count of the asked-for keys that are there; repeats count each time."""
    times = F.lit(0)
    for k in dict.fromkeys(keys):
        times = F.when(F.col("key") == k, F.lit(list(keys).count(k))).otherwise(times)
    return catalog.where(F.col("key").isin(list(keys))).agg(F.coalesce(F.sum(times), F.lit(0)).alias("n"))


def type_of(catalog: DataFrame, key: str) -> DataFrame:
    return catalog.agg(F.coalesce(F.max(F.when(F.col("key") == key, F.col("type"))), F.lit("none")).alias("type"))


def matching(catalog: DataFrame, pattern: str) -> DataFrame:
    return catalog.where(glob(F.col("key"), pattern)).select("key")


def size(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("keys"))


def random_key(catalog: DataFrame, seed: int = 0) -> DataFrame:
    return catalog.orderBy(F.xxhash64(F.lit(seed), F.col("key")), "key").limit(1).select("key")


def delete(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Any structure's rows without those keys."""
    return table.where(~F.col("key").isin(list(keys)))


def rename(table: DataFrame, source: str, destination: str, only_new: bool = False) -> DataFrame:
    """Rows of source under the name destination, whose old rows go."""
    if only_new and not table.where(F.col("key") == destination).isEmpty():
        return table
    kept = table.where((F.col("key") != destination) | F.lit(source == destination))
    return kept.withColumn("key", F.when(F.col("key") == source, F.lit(destination)).otherwise(F.col("key")))


def copy(table: DataFrame, source: str, destination: str, replace: bool = False) -> DataFrame:
    if not replace and not table.where(F.col("key") == destination).isEmpty():
        return table
    kept = table.where(F.col("key") != destination)
    return kept.unionByName(kept.where(F.col("key") == source).withColumn("key", F.lit(destination)))


def move(table: DataFrame, key: str, database: int) -> DataFrame:
    """To another database, unless the key is there already."""
    if not table.where((F.col("key") == key) & (F.col("db") == database)).isEmpty():
        return table
    return table.withColumn("db", F.when(F.col("key") == key, F.lit(database)).otherwise(F.col("db")))


def flush(table: DataFrame, database: int | None = None) -> DataFrame:
    return table.where(F.lit(False) if database is None else F.col("db") != database)


def _may(mode: str, at: Column) -> Column:
    old = F.col("expire_at")
    rules = {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (at > old), "LT": old.isNull() | (at < old)}
    if mode not in rules:
        raise ValueError(f"unknown condition {mode}")
    return F.coalesce(rules[mode], F.lit(False))


def expire(catalog: DataFrame, keys: Sequence[str], at, mode: str = "") -> DataFrame:
    """Set when keys go. No expiry counts as later than any time, so GT never sets one and LT does."""
    at = F.lit(at).cast("timestamp")
    mine = F.col("key").isin(list(keys)) & _may(mode, at)
    return catalog.withColumn("expire_at", F.when(mine, at).otherwise(F.col("expire_at")))


def persist(catalog: DataFrame, keys: Sequence[str]) -> DataFrame:
    return catalog.withColumn("expire_at", F.when(F.col("key").isin(list(keys)), F.lit(None).cast("timestamp")).otherwise(F.col("expire_at")))


def ttl(catalog: DataFrame, keys: Sequence[str], now, milliseconds: bool = False, absolute: bool = False) -> DataFrame:
    """Remaining time, or the time itself: -1 without expiry, -2 for a missing or expired key."""
    asked = catalog.sparkSession.createDataFrame(list(enumerate(keys)), "ordinal int, key string")
    now = F.unix_millis(F.lit(now).cast("timestamp"))
    own = catalog.where(F.col("key").isin(list(keys))).select("key", F.unix_millis("expire_at").alias("at"), F.lit(True).alias("have"))
    left = F.col("at") if absolute else F.col("at") - now
    shown = left if milliseconds else F.floor(left / 1000) if absolute else F.round(left / 1000).cast("bigint")
    value = F.when(F.col("have").isNull() | (F.col("at") <= now), F.lit(-2)).when(F.col("at").isNull(), F.lit(-1)).otherwise(shown)
    return asked.join(own, "key", "left").select("ordinal", "key", value.cast("bigint").alias("ttl")).orderBy("ordinal")


def sweep(table: DataFrame, now) -> DataFrame:
    """Compaction: rows whose time has come are dropped for good."""
    return table.where(F.col("expire_at").isNull() | (F.col("expire_at") > F.lit(now).cast("timestamp")))


def commit(before: DataFrame, ops: DataFrame, watched: DataFrame | None = None) -> tuple[bool, DataFrame]:
    """All of a batch of upserts (key, value) or none: none if a watched (key, version) has moved on.

    ``before`` has key, value, version; a write raises the version of its key by one.
    """
    if watched is not None:
        moved = watched.join(before.select("key", F.col("version").alias("now")), "key", "left").where(~F.col("version").eqNullSafe(F.col("now")))
        if not moved.isEmpty():
            return False, before
    new = ops.groupBy("key").agg(F.max_by("value", "seq").alias("new"), F.count(F.lit(1)).alias("writes"))
    both = before.join(new, "key", "full_outer")
    return True, both.select("key", F.when(F.col("writes").isNotNull(), F.col("new")).otherwise(F.col("value")).alias("value"), (F.coalesce("version", F.lit(0)) + F.coalesce("writes", F.lit(0))).alias("version"))
