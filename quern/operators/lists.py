"""Lists as (key, pos, value) rows; positions order a list and may have gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def push(lists: DataFrame, rows: DataFrame, left: bool = False, only_existing: bool = False) -> DataFrame:
    """Append (key, seq, value) at the tail, or in turn at the head."""
    edge = F.min("pos") - 1 if left else F.max("pos") + 1
    edges = lists.groupBy("key").agg(edge.alias("edge"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1
    placed = rows.withColumn("nth", nth).join(edges, "key", "inner" if only_existing else "left")
    start = F.coalesce("edge", F.lit(0))
    new = placed.select("key", (start - F.col("nth") if left else start + F.col("nth")).cast("long").alias("pos"), "value")
    return lists.select("key", F.col("pos").cast("long").alias("pos"), "value").unionByName(new)


def lengths(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def numbered(lists: DataFrame) -> DataFrame:
    """Every element's index in its list."""
    return lists.withColumn("index", F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1)


def heads(lists: DataFrame, n: int, tail: bool = False) -> DataFrame:
    """The first or last n of every list: a limit per group that runs before the shuffle."""
    order = F.col("pos").desc() if tail else F.col("pos").asc()
    return lists.withColumn("index", F.row_number().over(Window.partitionBy("key").orderBy(order)) - 1).where(F.col("index") < n)


def slice_(lists: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """From index start to stop, both included, negative ones from the end."""
    own = lists.where(F.col("key") == key).select("pos", "value")
    if start >= 0 and stop >= 0:
        head = own.orderBy("pos").limit(stop + 1)
        return head.offset(start) if start else head
    if start < 0 and stop < 0 and start <= stop:
        tail = own.orderBy(F.col("pos").desc()).limit(-start)
        return (tail.offset(-stop - 1) if stop < -1 else tail).orderBy("pos")
    n = own.count()
    first, last = max(0, start + n if start < 0 else start), min(n - 1, stop + n if stop < 0 else stop)
    if first > last:
        return own.limit(0)
    return own.orderBy("pos").limit(last + 1).offset(first)


def element(lists: DataFrame, key: str, index: int) -> DataFrame:
    return slice_(lists, key, index, index).select("value")


def _replaced(lists: DataFrame, key: str, own: DataFrame) -> DataFrame:
    return lists.where(F.col("key") != key).select("key", "pos", "value").unionByName(own.select(F.lit(key).alias("key"), "pos", "value"))


def trim(lists: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    return _replaced(lists, key, slice_(lists, key, start, stop))


def pop(lists: DataFrame, key: str, count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(popped in order, rest)."""
    own = lists.where(F.col("key") == key)
    popped = own.orderBy(F.col("pos").asc() if left else F.col("pos").desc()).limit(count)
    return popped, lists.join(popped.select("key", "pos"), ["key", "pos"], "left_anti")


def pop_first(lists: DataFrame, keys: Sequence[str], count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pop from the first of the keys that has elements."""
    place = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    first = lists.where(F.col("key").isin(list(keys))).agg(F.min_by("key", place).alias("key")).where("key is not null")
    own = lists.join(F.broadcast(first), "key", "left_semi")
    popped = own.orderBy(F.col("pos").asc() if left else F.col("pos").desc()).limit(count)
    return popped, lists.join(popped.select("key", "pos"), ["key", "pos"], "left_anti")


def move(lists: DataFrame, source: str, destination: str, from_left: bool = False, to_left: bool = True) -> DataFrame:
    popped, rest = pop(lists, source, 1, from_left)
    return push(rest, popped.select(F.lit(destination).alias("key"), F.lit(0).alias("seq"), "value"), to_left)


def set_at(lists: DataFrame, key: str, index: int, value: object) -> DataFrame:
    at = [r["pos"] for r in slice_(lists, key, index, index).select("pos").collect()]  # one row
    if not at:
        raise IndexError("index out of range")
    return lists.withColumn("value", F.when((F.col("key") == key) & (F.col("pos") == at[0]), F.lit(value)).otherwise(F.col("value")))


def insert(lists: DataFrame, key: str, pivot: object, value: object, before: bool = True) -> DataFrame:
    """Next to the first element that equals pivot; without one nothing changes."""
    at = lists.where((F.col("key") == key) & (F.col("value") == F.lit(pivot))).agg(F.min("pos").alias("pos")).first()["pos"]
    if at is None:
        return lists.select("key", "pos", "value")
    shifted = F.when((F.col("key") == key) & (F.col("pos") >= at if before else F.col("pos") > at), F.col("pos") + 1).otherwise(F.col("pos"))
    new = lists.sparkSession.createDataFrame([(key, at if before else at + 1, value)], lists.select("key", F.col("pos").cast("long").alias("pos"), "value").schema)
    return lists.select("key", shifted.cast("long").alias("pos"), "value").unionByName(new)


def remove(lists: DataFrame, key: str, count: int, value: object) -> DataFrame:
    """The first count matches, the last ones for a negative count, all for 0."""
    hit = lists.where((F.col("key") == key) & (F.col("value") == F.lit(value))).select("key", "pos")
    if count:
        hit = hit.orderBy(F.col("pos").asc() if count > 0 else F.col("pos").desc()).limit(abs(count))
    return lists.join(hit, ["key", "pos"], "left_anti")


def positions(lists: DataFrame, key: str, value: object, rank: int = 1, count: int | None = 1, maxlen: int = 0) -> DataFrame:
    """Indexes of matches from the rank-th one on; negative ranks search from the tail. count 0: all."""
    if rank == 0:
        raise ValueError("rank must not be 0")
    own = lists.where(F.col("key") == key)
    n = own.count()
    found = own.withColumn("index", F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1)
    if maxlen:
        found = found.where(F.col("index") < maxlen if rank > 0 else F.col("index") >= n - maxlen)
    hits = found.where(F.col("value") == F.lit(value)).orderBy(F.col("index").asc() if rank > 0 else F.col("index").desc()).offset(abs(rank) - 1)
    return (hits.limit(count) if count else hits).select("index")


def as_array(lists: DataFrame) -> DataFrame:
    """One row a key with all elements in order: for lists of bounded size."""
    pairs = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return lists.groupBy("key").agg(F.transform(pairs, lambda p: p["value"]).alias("values"))


