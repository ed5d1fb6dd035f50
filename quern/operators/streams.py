"""Streams as (key, ms, seq, fields) rows, and consumer groups over them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = (1 << 63) - 1


def parse_id(text: str, last: bool = False) -> tuple[int, int]:
    """ms-seq, ms alone, - or +."""
    if text == "-":
        return 0, 0
    if text == "+":
        return MOST, MOST
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else (MOST if last else 0)


def _after(at: tuple[int, int], strict: bool) -> Column:
    ms, seq = F.col("ms"), F.col("seq")
    return (ms > at[0]) | ((ms == at[0]) & (seq > at[1] if strict else seq >= at[1]))


def _until(at: tuple[int, int], strict: bool) -> Column:
    ms, seq = F.col("ms"), F.col("seq")
    return (ms < at[0]) | ((ms == at[0]) & (seq < at[1] if strict else seq <= at[1]))


def assign_ids(rows: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Automatic ids for (key, arrival, now, ...): the greater of now and the last time, and a sequence in it."""
    order = Window.partitionBy("key").orderBy("arrival")
    start = F.lit(None).cast("long")
    if last is not None:
        rows = rows.join(last.select("key", F.col("ms").alias("last_ms"), F.col("seq").alias("last_seq")), "key", "left")
        start = F.col("last_ms")
    ms = F.greatest(F.max("now").over(order.rowsBetween(Window.unboundedPreceding, 0)), start)
    timed = rows.withColumn("ms", ms)
    nth = F.row_number().over(Window.partitionBy("key", "ms").orderBy("arrival")) - 1
    if last is None:
        return timed.withColumn("seq", nth.cast("long"))
    follows = F.when(F.col("ms") == F.col("last_ms"), F.col("last_seq") + 1).otherwise(F.lit(0))
    return timed.withColumn("seq", (nth + follows).cast("long")).drop("last_ms", "last_seq")


def rejected_ids(rows: DataFrame) -> DataFrame:
    """Of (key, arrival, ms, seq): entries whose id is not above every id that came before, or is 0-0."""
    place = F.struct("ms", "seq")
    before = F.max(place).over(Window.partitionBy("key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).where((F.col("before").isNotNull() & (place <= F.col("before"))) | ((F.col("ms") == 0) & (F.col("seq") == 0))).drop("before")


def lengths(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def id_range(stream: DataFrame, key: str, start: str = "-", end: str = "+", count: int | None = None, reverse: bool = False) -> DataFrame:
    """Entries from start to end, both included; ( excludes."""
    a, b = start.removeprefix("("), end.removeprefix("(")
    held = _after(parse_id(a), start.startswith("(")) & _until(parse_id(b, True), end.startswith("("))
    order = [F.col("ms").desc(), F.col("seq").desc()] if reverse else [F.col("ms").asc(), F.col("seq").asc()]
    out = stream.where((F.col("key") == key) & held).orderBy(*order)
    return out if count is None else out.limit(count)


def read(stream: DataFrame, after: dict[str, str], count: int | None = None) -> DataFrame:
    """Entries strictly after each stream's id, at most count of each; $ is the newest id, so nothing."""
    held = F.lit(False)
    for key, at in after.items():
        held = held | ((F.col("key") == key) & (F.lit(False) if at == "$" else _after(parse_id(at), True)))
    out = stream.where(held)
    if count is not None:
        nth = F.row_number().over(Window.partitionBy("key").orderBy("ms", "seq"))
        out = out.withColumn("_nth", nth).where(F.col("_nth") <= count).drop("_nth")
    return out


def delete(stream: DataFrame, ids: DataFrame) -> DataFrame:
    return stream.join(ids.select("key", "ms", "seq").distinct(), ["key", "ms", "seq"], "left_anti")


def deletion_status(stream: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """1 for an id that is there and goes, -1 for one that is not."""
    asked = stream.sparkSession.createDataFrame([(i, *parse_id(x)) for i, x in enumerate(ids)], "ordinal int, ms long, seq long")
    have = stream.where(F.col("key") == key).select("ms", "seq", F.lit(1).alias("have"))
    return asked.join(have, ["ms", "seq"], "left").select("ordinal", F.coalesce("have", F.lit(-1)).alias("status")).orderBy("ordinal")


def trim(stream: DataFrame, key: str, newest: int) -> DataFrame:
    """Keeps the newest entries of one stream."""
    kept = stream.where(F.col("key") == key).orderBy(F.col("ms").desc(), F.col("seq").desc()).limit(newest)
    return stream.where(F.col("key") != key).unionByName(kept)


def info(stream: DataFrame) -> DataFrame:
    """Per stream: length, first and last id."""
    place = F.struct("ms", "seq")
    return stream.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(place).alias("first"), F.max(place).alias("last"))


#: Commands of the group log and what a row has: seq, key, grp, cmd, consumer, id (ms-seq, > or none), ids, n, now, idle.
GROUP_COMMANDS = ("CREATE", "SETID", "DESTROY", "READ", "READ_NOACK", "ACK", "CLAIM", "AUTOCLAIM", "DELCONSUMER")


class Group:
    """One consumer group: what was delivered last, and what is pending."""

    def __init__(self, entries: list[tuple[int, int]]):
        self.entries, self.last, self.pending = entries, (0, 0), {}

    def command(self, cmd: str, consumer: str | None, at: str | None, ids: list[str] | None, n: int | None, now: int, idle: int | None) -> list[tuple[int, int]]:
        """Ids that the command delivers, acknowledges or claims. pending: id -> [consumer, delivered at, deliveries]."""
        match cmd:
            case "CREATE" | "SETID":
                self.last = self.entries[-1] if at == "$" and self.entries else parse_id(at or "0")
                return []
            case "READ" | "READ_NOACK" if at == ">":
                first = bisect_right(self.entries, self.last)
                found = self.entries[first : first + n if n else None]
                if found:
                    self.last = found[-1]
                if cmd == "READ":
                    for x in found:
                        self.pending[x] = [consumer, now, 1]
                return found
            case "READ" | "READ_NOACK":  # an id replays the consumer's own pending entries after it
                found = sorted(x for x, p in self.pending.items() if p[0] == consumer and x > parse_id(at))
                return found[:n] if n else found
            case "ACK":
                return [x for x in map(parse_id, ids or []) if self.pending.pop(x, None) is not None]
            case "CLAIM":
                found = [x for x in map(parse_id, ids or []) if x in self.pending and now - self.pending[x][1] >= (idle or 0)]
            case "AUTOCLAIM":
                found = sorted(x for x, p in self.pending.items() if x >= parse_id(at or "0") and now - p[1] >= (idle or 0))[: n or 100]
            case "DELCONSUMER":
                gone = sorted(x for x, p in self.pending.items() if p[0] == consumer)
                for x in gone:
                    del self.pending[x]
                return gone
            case "DESTROY":
                self.pending, self.last = {}, (0, 0)
                return []
            case _:
                raise ValueError(f"unknown command {cmd}")
        for x in found:
            self.pending[x] = [consumer, now, self.pending[x][2] + 1]
        return found


def replay_groups(stream: DataFrame, log: DataFrame) -> DataFrame:
    """Runs an ordered log of group commands: one row an id that a command touches, and at the
    end one a pending entry (cmd PENDING).

    A group's deliveries depend on all before them, so a group is one task; groups run apart. Only
    ids meet there, not fields.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        entries = sorted(zip(left["ms"].to_pylist(), left["seq"].to_pylist(), strict=True))
        group, out = Group(entries), []
        rows = sorted(right.to_pylist(), key=lambda r: r["seq"])
        key = (rows[0]["key"], rows[0]["grp"]) if rows else None
        for r in rows:
            for x in group.command(r["cmd"], r["consumer"], r["id"], r["ids"], r["n"], r["now"], r["idle"]):
                p = group.pending.get(x)
                out.append((*key, r["seq"], r["cmd"], r["consumer"], *x, p[2] if p else None))
        for x, p in sorted(group.pending.items()):
            out.append((*key, None, "PENDING", p[0], *x, p[2]))
        names = ["key", "grp", "at", "cmd", "consumer", "ms", "seq", "deliveries"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    # fresh names on both sides: log and stream may come from one table
    groups = log.select(F.col("key").alias("k"), F.col("grp").alias("g")).distinct()
    entries = stream.select("key", "ms", "seq").join(groups, F.col("key") == F.col("k")).select("k", "g", "ms", "seq").groupBy("k", "g")
    commands = log.select(*[F.col(c).alias(c) for c in ("key", "grp", "seq", "cmd", "consumer", "id", "ids", "n", "now", "idle")]).groupBy("key", "grp")
    return entries.cogroup(commands).applyInArrow(run, "key string, grp string, at long, cmd string, consumer string, ms long, seq long, deliveries long")


def pending_summary(pending: DataFrame) -> DataFrame:
    """Of PENDING rows: count, least and greatest id, and counts by consumer."""
    place = F.struct("ms", "seq")
    by_consumer = pending.groupBy("key", "grp", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    return by_consumer.groupBy("key", "grp").agg(
        F.sum("n").alias("count"), F.min("low").alias("first"), F.max("high").alias("last"), F.sort_array(F.collect_list(F.struct("consumer", "n"))).alias("consumers")
    )


def pending_range(pending: DataFrame, start: str = "-", end: str = "+", count: int = 10, consumer: str | None = None) -> DataFrame:
    held = _after(parse_id(start), False) & _until(parse_id(end, True), False)
    out = pending.where(held if consumer is None else held & (F.col("consumer") == consumer))
    return out.orderBy("ms", "seq").limit(count)
