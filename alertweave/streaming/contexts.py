"""Streaming forms of the strict-past context and of the interval label."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertweave.operators.joins import label_by_interval

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSING = "\x00closing"
_SLOT = "timestamp long, row_id long, event_id int"
#: Alerts in a block of waiting rows, and in a frame of results.
BLOCK = 2_000
#: Arriving alerts of a machine that are put in order before they go to the state store.
GATHERED = 200_000
_OUTPUT = "machine string, timestamp long, row_id long, event_id int, context array<int>"


class StrictPastProcessor(StatefulProcessor):
    """Per machine: the last `n` released alerts and the alerts waiting for their second to close.

    Waiting alerts lie in the state store by second, in blocks, with a timer for each
    second. Arriving frames are gathered first, up to a bound, as each visit to the store costs the
    same for one alert as for a block; an expiry holds one block and `n` alerts. A second closes when the watermark passes it; then its alerts are released with
    one shared context and join the history. Alerts later than the watermark never
    reach the processor.
    """

    def __init__(self, n: int, timeout: int):
        self.n, self.timeout = n, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getListState("history", _SLOT)
        self.blocks = handle.getMapState("blocks", "timestamp long", "blocks long")
        self.waiting = handle.getMapState("waiting", "timestamp long, block long", "row_ids array<long>, event_ids array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, held = [], 0
        for batch in rows:
            frames.append(batch[["timestamp", "row_id", "event_id"]])
            held += len(batch)
            if held >= GATHERED:
                self._wait(pd.concat(frames))
                frames, held = [], 0
        if held:
            self._wait(pd.concat(frames))
        yield pd.DataFrame()

    def _wait(self, arrived: pd.DataFrame) -> None:
        arrived = arrived.sort_values(["timestamp", "row_id", "event_id"])
        for second, tied in arrived.groupby("timestamp", sort=True):
            second, row_ids, event_ids = int(second), tied["row_id"].tolist(), tied["event_id"].tolist()
            if self.blocks.containsKey((second,)):
                count = self.blocks.getValue((second,))[0]
            else:
                count = 0
                self.handle.registerTimer(second * 1000 + 1)
            for at in range(0, len(row_ids), BLOCK):
                self.waiting.updateValue((second, count), (row_ids[at : at + BLOCK], event_ids[at : at + BLOCK]))
                count += 1
            self.blocks.updateValue((second,), (count,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers expire in the order of their seconds
        second = (expiredTimerInfo.getExpiryTimeInMs() - 1) // 1000
        history = [tuple(s) for s in self.history.get()]
        context = [e for t, _, e in history if second - t <= self.timeout]
        for block in range(self.blocks.getValue((second,))[0]):
            row_ids, event_ids = self.waiting.getValue((second, block))
            self.waiting.removeKey((second, block))
            out = [(key[0], second, r, e, context) for r, e in zip(row_ids, event_ids)]
            history = sorted(history + [(second, r, e) for r, e in zip(row_ids, event_ids)])[-self.n :]
            yield pd.DataFrame(out, columns=["machine", "timestamp", "row_id", "event_id", "context"])
        self.blocks.removeKey((second,))
        self.history.put(history)

    def close(self) -> None:
        pass


def stream_strict_past_context(alerts: DataFrame, n: int = 10, timeout: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """Streaming strict-past context; equals the batch operator on alerts that arrive within `delay`.

    The last seconds of a source that ends wait for the watermark; `closing_row`
    in a further input releases them. Needs the RocksDB state store
    (`use_state_store`); `late_rows` tells how many alerts came after `delay`.
    """
    timed = alerts.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy("machine").transformWithStateInPandas(
        statefulProcessor=StrictPastProcessor(n, timeout), outputStructType=_OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def closing_row(spark: SparkSession, last: int) -> DataFrame:
    """A row past `last` and any delay, of a machine of its own, that lets the watermark pass all alerts."""
    return spark.createDataFrame([(CLOSING, int(last), -1, -1)], "machine string, timestamp long, row_id long, event_id int")


def late_rows(job) -> int:
    """Rows that a finished streaming job dropped behind its watermark."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in job.recentProgress for o in p["stateOperators"])


def stream_label_by_interval(alerts: DataFrame, intervals: DataFrame, name: str = "attack_id") -> DataFrame:
    """Stream-static form of the interval label: the batch operator, whose interval side is static."""
    return label_by_interval(alerts, intervals, name)
