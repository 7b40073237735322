"""Late rejection with Spark's keyed streaming state (RocksDB), forgetting idle shots.

Each shot's last accepted time is a state value. It is forgotten

* ``ttl_ms`` of processing time after it was last written (``idle="processing"``), or
* when the watermark passes its last accepted time by ``ttl_ms`` (``idle="event"``): a timer a shot, set
  anew with every batch that holds the shot. Points behind the watermark are dropped by Spark before they
  are judged and counted in the query's progress (``numRowsDroppedByWatermark``).

All points of a shot in a batch go through one task, in bounded frames after a sort by arrival; where one
shot holds a large part of a stream, ``pipeline.RiskStream`` splits it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shotstream.operators import ingest
from shotstream.schema import CHANNELS

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_POINT = "arrival bigint, ts_unix_ns bigint, channels array<struct<name: string, value: double, quality: string>>"
JUDGED = f"shot_id string, {_POINT}, reason string"


class LastAccepted(StatefulProcessor):
    """Marks points whose time does not exceed the last accepted one of their shot."""

    def __init__(self, ttl_ms: int, idle: str) -> None:
        self.ttl_ms, self.idle = ttl_ms, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = self.ttl_ms if self.idle == "processing" else None
        self.last = handle.getValueState("last_ts", "last_ts bigint", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Frames come in no order of arrival.
        points = pd.concat(rows).sort_values("arrival", kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        times = points["ts_unix_ns"]
        highest = times.cummax().shift(1, fill_value=times.iloc[0] - 1 if before is None else before)
        late = times <= (highest if before is None else highest.clip(lower=before))
        newest = int(times.max() if before is None else max(before, times.max()))
        self.last.update((newest,))
        if self.idle == "event":
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest // 1_000_000 + self.ttl_ms)
        points["shot_id"] = key[0]
        points["reason"] = late.map({True: ingest.LATE, False: None})
        yield points[["shot_id", "arrival", "ts_unix_ns", "channels", "reason"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, off the heap and checkpointed by changes."""
    spark.conf.set(STORE, ROCKS_DB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def judged_stream(
    messages: DataFrame, ttl_ms: int, idle: str = "processing", delay: str = "10 minutes",
    allowed: Sequence[str] = CHANNELS, max_channels: int | None = 128,
) -> DataFrame:
    """Every message of a stream with ``reason``, null where it is accepted. ``delay`` is how far the
    watermark stays behind the newest time (``idle="event"``)."""
    if idle not in ("processing", "event"):
        raise ValueError("idle must be processing or event")
    use_rocksdb(messages.sparkSession)
    points = ingest.validate(ingest.decode(messages), allowed, max_channels)
    refused = points.filter("reason is not null").select("shot_id", "arrival", "ts_unix_ns", "channels", "reason")
    valid = points.filter("reason is null").drop("reason")
    if idle == "event":
        valid = valid.withColumn("at", F.timestamp_micros(F.expr("ts_unix_ns div 1000"))).withWatermark("at", delay)
    judged = valid.groupBy("shot_id").transformWithStateInPandas(
        LastAccepted(ttl_ms, idle), JUDGED, "Append", "EventTime" if idle == "event" else "ProcessingTime"
    )
    return judged.unionByName(refused)


def start(judged: DataFrame, path: str, checkpoint: str, idle: str = "processing", **trigger) -> StreamingQuery:
    """Write a judged stream to Parquet files, exactly once; all that is there and then stop, by default.

    State with a time to live asks for batches without data for ever, so that a run over what is there
    would never end. Such batches are off with it: values are forgotten when data comes or on access.
    Timers by event time need them; they end with the last timer that is due.
    """
    conf, key = judged.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, str(idle == "event").lower())
    try:
        writer = judged.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(key, before)
