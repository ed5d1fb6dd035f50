"""Streaming reads: tails of a log, blocking pops as micro-batches, windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tail(stream: DataFrame, after: dict[str, tuple[int, int]]) -> DataFrame:
    """Entries of a streaming (key, ms, seq, fields) frame strictly after each stream's id."""
    held: Column = F.lit(False)
    for key, (ms, seq) in after.items():
        held = held | ((F.col("key") == key) & ((F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") > seq))))
    return stream.where(held)


def waiting(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """A blocking read: ``handle`` gets each batch when there is one. With available_now it returns when all is read."""
    writer = stream.writeStream.foreachBatch(lambda df, n: None if df.isEmpty() else handle(df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts_per_window(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window; events later than the watermark are dropped, state with them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Entries seen once per id within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
