"""Consumer groups over a stream: per-key state of deliveries, on the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Deliveries(StatefulProcessor):
    """Deals entries to consumers in turn and keeps what is pending.

    Input rows: key, kind ('entry' or 'ack'), ms, seq. Output: key, consumer, ms, seq, for
    each delivery. An id at or below the last delivered one is not delivered again.
    """

    def __init__(self, consumers: list[str]):
        self.consumers = consumers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long, seq long, turn long")
        self.pending = handle.getMapState("pending", "ms long, seq long", "consumer string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms, seq, turn = self.last.get() if self.last.exists() else (-1, -1, 0)
        out = []
        for df in rows:
            for r in df.sort_values(["ms", "seq"]).itertuples():
                at = (int(r.ms), int(r.seq))
                if r.kind == "ack":
                    if self.pending.containsKey(at):
                        self.pending.removeKey(at)
                elif at > (ms, seq):
                    (ms, seq), consumer = at, self.consumers[turn % len(self.consumers)]
                    turn += 1
                    self.pending.updateValue(at, (consumer,))
                    out.append((key[0], consumer, *at))
        self.last.update((ms, seq, turn))
        yield pd.DataFrame(out, columns=["key", "consumer", "ms", "seq"])

    def close(self) -> None:
        pass


def deliveries(stream: DataFrame, consumers: list[str]) -> DataFrame:
    """stream: key, kind, ms, seq. Needs the RocksDB state store provider."""
    return stream.groupBy("key").transformWithStateInPandas(Deliveries(consumers), "key string, consumer string, ms long, seq long", "append", "none")
