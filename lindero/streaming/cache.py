"""A keyed cache with a time to live, as a stream: entries are put and asked for, and run out by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a request gets: the payload while it is fresh, and the last one however old it is, as long as it is kept.
ANSWER = "key string, at timestamp, payload string, stale string"


class _Cache(StatefulProcessor):
    def __init__(self, fresh: int, kept: int) -> None:
        self.fresh, self.kept = fresh, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "payload string, put long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows of a key in one batch are few; a put and a request of one time come in that order.
        batch = pd.concat(list(rows))
        batch = batch.assign(asked=batch["payload"].isna()).sort_values(["at", "asked"], kind="stable")
        held = self.entry.get() if self.entry.exists() else None
        out = []
        for at, payload in zip(batch["at"], batch["payload"], strict=True):
            now = at.value // 1_000_000
            if not pd.isna(payload):
                if held is None or now >= held[1]:
                    held = (payload, now)
            else:
                kept = held is not None and now - held[1] <= self.kept
                out.append((key[0], at, held[0] if kept and now - held[1] <= self.fresh else None, held[0] if kept else None))
        if held is not None:
            self.entry.update(held)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(held[1] + self.kept)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "payload", "stale"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield from ()

    def close(self) -> None:
        pass


def answers(stream: DataFrame, fresh_seconds: int, kept_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """ANSWER for each request of a stream of key, at (timestamp) and payload, which is null for a request.

    A request sees what was put up to its time; a later put replaces an entry. An entry is fresh for so many seconds, and
    when the watermark has passed the time that it is kept for, a timer drops it from the state. Needs the state store
    org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
    """
    timed = stream.select("key", "at", "payload").withWatermark("at", lateness)
    processor = _Cache(1000 * fresh_seconds, 1000 * kept_seconds)
    return timed.groupBy("key").transformWithStateInPandas(processor, ANSWER, "Append", "EventTime")
