"""Texts that live and expire in a stream of puts, and sessions of a stream.

A key's state is the moment at which it was last put. A put within its time to live renews it; a timer on the event time ends it, at
the moment at which its time is over, once the watermark has passed that. State and timers lie in the checkpoint: a query
that starts again goes on where it stopped, and a key without puts holds no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PUT, RENEWED, EXPIRED = "put", "renewed", "expired"
HAPPENED = Row("doc_id", "at_us", "what")


class Expiry(StatefulProcessor):
    """Rows (doc_id, stored_us) to rows (doc_id, at_us, what); microseconds since 1970."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at_us long")

    def _timer(self, at: int) -> int:
        """The first whole millisecond at which a text that was put at that moment lives no longer."""
        return (at + self.ttl) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        puts = sorted(r[1] for r in rows)
        before = self.stored.get()[0] if self.stored.exists() else None
        last, found = before, []
        for at in puts:
            if last is not None and at < last:  # a put that the stream brings late renews nothing
                found.append((at, RENEWED))
                continue
            if last is not None and at - last > self.ttl:
                found.append((last + self.ttl, EXPIRED))
                last = None
            found.append((at, PUT if last is None else RENEWED))
            last = at
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.stored.update((last,))
            self.handle.registerTimer(self._timer(last))
        return (HAPPENED(key[0], at, what) for at, what in found)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last = self.stored.get()[0] if self.stored.exists() else None
        if last is not None and self._timer(last) <= expiredTimerInfo.getExpiryTimeInMs():
            self.stored.clear()
            yield HAPPENED(key[0], last + self.ttl, EXPIRED)

    def close(self) -> None:
        pass


def lifetimes(puts: DataFrame, ttl: int, late: str = "10 minutes") -> DataFrame:
    """(doc_id, at, what) of a stream of puts (doc_id, stored_at): put, renewed and expired, by the time to live in seconds.

    Puts may come late by so much. Rows without an id or a time are left out. The session's state store must be STATE_STORE.
    """
    marked = puts.where("doc_id is not null and stored_at is not null").withWatermark("stored_at", late)
    rows = marked.select("doc_id", F.unix_micros("stored_at").alias("stored_us"), "stored_at")
    kind = puts.schema["doc_id"].dataType.simpleString()
    out = rows.groupBy("doc_id").transformWithState(Expiry(ttl * 1_000_000), f"doc_id {kind}, at_us long, what string", "Append", "EventTime")
    return out.select("doc_id", F.timestamp_micros("at_us").alias("at"), "what")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of the sessions of each key: what follows within the gap belongs together, and the end is the last row's plus the gap.

    For batches and streams alike; a stream gives a session once the watermark has passed its end.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.withWatermark(at, late) if events.isStreaming else rows
    found = rows.groupBy(key, F.session_window(at, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def run_to_end(out: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, append its rows to a folder, and return all that the folder holds."""
    spark = out.sparkSession
    out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(folder)
