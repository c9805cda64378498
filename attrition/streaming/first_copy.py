"""The first copy of each key of a stream, by an order column instead of by arrival.

A key's state is the row with the least order seen so far.  It is emitted, and the state
dropped, once the watermark passes the event time of the key's first arrival plus
the watermark's delay, so state is bounded by the keys of that span.  Copies that come
later open the key again, as with ``dropDuplicatesWithinWatermark``.  Rows behind the
watermark, or without an event time, are dropped.  Of rows with equal order the first to arrive stays;
a null order comes last.  Needs the RocksDB state store (``rocksdb_state``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's setting comes back after."""

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class FirstCopy(StatefulProcessor):
    """Rows are (kept columns..., order, expiry in milliseconds); output is the kept columns."""

    def __init__(self, state: StructType, kept: int, delay: int):
        self.state, self.kept, self.delay = state, kept, delay
        self.names = state.names[:kept]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.first.get() if self.first.exists() else None
        if held is not None and held[self.kept + 1] <= now:  # its timer goes off in this batch, after these rows
            self.handle.deleteTimer(held[self.kept + 1])
            self.first.clear()
            yield self._kept(held)
            held = None
        least, expiry = (None, None) if held is None else (held, held[self.kept + 1])
        for row in rows:
            if row[self.kept + 1] is None or row[self.kept + 1] - self.delay < now:
                continue
            if least is None or _before(row[self.kept], least[self.kept]):
                least = row
            if expiry is None:
                expiry = row[self.kept + 1]
                self.handle.registerTimer(expiry)
        if least is not held:
            self.first.update((*least[:self.kept + 1], expiry))

    def _kept(self, row: Row) -> Row:
        return Row(*self.names)(*row[:self.kept])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        least = self.first.get()
        self.first.clear()
        yield self._kept(least)


def _before(order, other) -> bool:
    return order is not None and (other is None or order < other)


def first_copies(stream: DataFrame, key: str, order_col: str, event_time: str, watermark: str = "1 day") -> DataFrame:
    """One row per ``key``, that of the least ``order_col``; ``order_col`` itself is left out."""

    kept = [c for c in stream.columns if c != order_col]
    spark = stream.sparkSession
    delay = spark.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {watermark})")).first()[0]
    rows = stream.withWatermark(event_time, watermark).select(
        *kept, F.col(order_col).alias("_order"), (F.unix_millis(event_time) + F.lit(delay)).alias("_expiry"))
    processor = FirstCopy(rows.schema, len(kept), delay)
    out = rows.groupBy(key).transformWithState(processor, StructType(rows.schema.fields[:len(kept)]), "Append", "EventTime")
    return out.select(*kept)
