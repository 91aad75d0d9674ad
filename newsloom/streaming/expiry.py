"""Event-time expiry per key (J3): a key is let through once per window, with a timer that ends its state.

The rule is stated on event times alone: a row passes if no row of its key that passed lies within the window
before (or, for a row that arrives late, behind) it.  State per key is the time of the last row that passed; a
timer of event time ends it exactly one window later, so the state holds only keys seen inside the window and the
watermark's delay.  As nothing depends on when a batch ends, any grouping of the arrivals into batches gives the
same rows, as long as rows of one key do not arrive in an earlier batch than rows before them.  (With a delay longer than
the window, rows that come more than a window late are judged against each other inside their batch only.)
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstPerWindow(StatefulProcessor):
    """Rows ``(key, ts_us, id)`` of one key at a time; passes the first row of every window."""

    def __init__(self, window_us: int) -> None:
        self.window = window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "ts_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        # The key's rows of one batch, as numbers and ids only.
        batch = sorted(((r.ts_us, r.id) for r in rows), key=lambda r: (r[0], r[1] is None, r[1]))
        state = self.kept.get()
        last = None if state is None else state[0]
        before, late, at = last, None, 0
        while at < len(batch):
            ts, row_id = batch[at]
            if last is None or ts - last >= self.window:
                yield Row(key=key[0], ts_us=ts, id=row_id)
                last = ts
            elif last - ts >= self.window and (late is None or ts - late >= self.window):
                yield Row(key=key[0], ts_us=ts, id=row_id)   # from before the window of the last one, whose place it does not take
                late = ts
            elif ts >= last:   # on to the first row that can pass
                at = bisect_left(batch, last + self.window, lo=at, key=lambda r: r[0])
                continue
            at += 1
        if last is not None and last != before:
            self.kept.update((last,))
            self.handle.registerTimer((last + self.window) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        state = self.kept.get()
        if state is not None and (state[0] + self.window) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_per_window(stream: DataFrame, key: str, ts_col: str, id_col: str, window_hours: int = 48,
                     delay: str = "48 hours") -> DataFrame:
    """``(key, id, ts)`` of the rows that pass; rows of equal time pass by the smallest id.

    Null keys are one key, as in ``dropDuplicates``.  Rows later than ``delay`` behind the newest are dropped by
    the watermark.
    """
    micros = window_hours * 3_600_000_000
    id_type = stream.schema[id_col].dataType.simpleString()
    key_type = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts_col, delay).select(
        F.col(key).alias("key"), F.unix_micros(ts_col).alias("ts_us"), F.col(id_col).alias("id"), F.col(ts_col).alias("event_ts"))
    # By rows and not by frames: a key has few rows in a batch, and a frame of its own would cost more than they do.
    out = rows.groupBy("key").transformWithState(
        FirstPerWindow(micros), f"key {key_type}, ts_us long, id {id_type}", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.col("id").alias(id_col), F.timestamp_micros("ts_us").alias(ts_col))


class keyed_state:
    """Within this context streams are started on the state store that timers need; the setting is put back after."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER_KEY, None)
        self.spark.conf.set(PROVIDER_KEY, ROCKSDB)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER_KEY)
        else:
            self.spark.conf.set(PROVIDER_KEY, self.before)


def state_sizes(query) -> list[dict]:
    """Keys held, keys removed and memory of the state, per micro-batch of a finished query."""
    return [{"batch": p.batchId, "rows": sum(int(op.numRowsTotal) for op in p.stateOperators),
             "removed": sum(int(op.numRowsRemoved) for op in p.stateOperators),
             "bytes": sum(int(op.memoryUsedBytes) for op in p.stateOperators)} for p in query.all_progress]
