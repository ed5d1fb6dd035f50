"""Sets as (key, member) rows: each operator is one aggregation, whatever the number of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.keys import glob


def add(sets: DataFrame, rows: DataFrame) -> DataFrame:
    return sets.select("key", "member").unionByName(rows.select("key", "member")).distinct()


def added(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """How many new members each key gets."""
    new = rows.select("key", "member").distinct().join(sets, ["key", "member"], "left_anti")
    return new.groupBy("key").agg(F.count(F.lit(1)).alias("added"))


def remove(sets: DataFrame, rows: DataFrame) -> DataFrame:
    return sets.join(rows.select("key", "member").distinct(), ["key", "member"], "left_anti")


def move(sets: DataFrame, source: str, destination: str, member: object) -> DataFrame:
    moved = sets.where((F.col("key") == source) & (F.col("member") == F.lit(member))).select(F.lit(destination).alias("key"), "member")
    kept = sets.where(~((F.col("key") == source) & (F.col("member") == F.lit(member))))
    return kept.unionByName(moved).distinct()


def cardinality(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count_distinct("member").alias("card"))


def is_member(sets: DataFrame, key: str, members: Sequence[object]) -> DataFrame:
    """One row a member asked for, in order."""
    have = sets.where((F.col("key") == key) & F.col("member").isin(list(members))).select("member").distinct()
    asked = sets.sparkSession.createDataFrame(list(enumerate(members)), f"ordinal int, member {dict(sets.dtypes)['member']}")
    return asked.join(have.withColumn("found", F.lit(1)), "member", "left").select("ordinal", "member", F.coalesce("found", F.lit(0)).alias("found")).orderBy("ordinal")


def _of(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sets.where(F.col("key").isin(list(keys)))



def union(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _of(sets, keys).select("member").distinct()


def intersection(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = len(set(keys))
    return _of(sets, keys).groupBy("member").agg(F.count_distinct("key").alias("n")).where(F.col("n") == n).select("member")


def difference(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of the first key that no other key has."""
    held = _of(sets, keys).groupBy("member").agg(F.max(F.col("key") == keys[0]).alias("own"), F.max(F.col("key").isin(list(keys[1:]) or [""])).alias("other"))
    if keys[0] in keys[1:]:
        return held.where(F.lit(False)).select("member")
    return held.where(F.col("own") & ~F.col("other")).select("member")


def intersection_size(sets: DataFrame, keys: Sequence[str], limit: int = 0) -> DataFrame:
    size = intersection(sets, keys).agg(F.count(F.lit(1)).alias("card"))
    return size.select(F.least("card", F.lit(limit)).alias("card")) if limit else size


def random_members(sets: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """Distinct members for a positive count; for a negative one, draws with replacement."""
    own = sets.where(F.col("key") == key).select("member").distinct()
    mixed = F.xxhash64(F.lit(seed), F.col("member").cast("string"))
    if count >= 0:
        return own.orderBy(mixed, "member").limit(count)
    # every member has a number: that of its part of the hash range (4096 of them), and its place in the part
    placed = own.withColumn("part", F.shiftright(mixed, 52)).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(mixed, "member")) - 1)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total, total + n))
        total += n
    spark = sets.sparkSession
    draws = spark.range(-count).select(F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(max(total, 1))).alias("at"))
    parts = F.broadcast(spark.createDataFrame(starts, "part long, first long, stop long"))
    drawn = draws.join(parts, (F.col("at") >= F.col("first")) & (F.col("at") < F.col("stop"))).select("part", (F.col("at") - F.col("first")).alias("place"))
    return drawn.join(placed, ["part", "place"]).select("member")


def scan(sets: DataFrame, key: str, after: object = None, match: str | None = None, count: int = 10) -> DataFrame:
    own = sets.where(F.col("key") == key).select("member").distinct()
    page = own if after is None else own.where(F.col("member") > F.lit(after))
    page = page.orderBy("member").limit(count)
    return page.where(glob(F.col("member").cast("string"), match)) if match else page
