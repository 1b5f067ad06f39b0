"""Streaming compaction: 15-minute buckets as state, finalised by timers, opened again by late events.

A bucket of a provider keeps its sums and the keys that it has counted, so a key said again, in a later batch or after a
restart too, counts once.  When a bucket changes, a timer is set; as it goes off the bucket is given out as it is then,
under its next version.  No event is too late: one that comes a day later changes its bucket and brings out a new version.
The state is in RocksDB below the checkpoint; a key is forgotten after a stated time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import exprs as X

COLUMNS = "bucket timestamp, providerKey string, events long, input_tokens long, output_tokens long, version long"
#: Milliseconds between a bucket's first change and its next version; for which a counted key is remembered.
DELAY, REMEMBERED = 30 * 60 * 1000, 400 * 86_400_000


class Buckets(StatefulProcessor):
    def __init__(self, delay: int, remembered: int):
        self.delay, self.remembered = delay, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counted = handle.getMapState("counted", "dedupKey string", "one boolean", self.remembered)
        self.sums = handle.getValueState("sums", "events long, input_tokens long, output_tokens long, version long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        events, taken, given, version, due = self.sums.get() if self.sums.exists() else (0, 0, 0, 0, 0)
        before = events
        for part in rows:
            for name, a, b in zip(part["dedupKey"], part["inputTokens"], part["outputTokens"]):
                if not self.counted.containsKey((name,)):
                    self.counted.updateValue((name,), (True,))
                    events, taken, given = events + 1, taken + int(a), given + int(b)
        if events > before and not due:
            due = timerValues.getCurrentProcessingTimeInMs() + self.delay
            self.handle.registerTimer(due)
        self.sums.update((events, taken, given, version, due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        events, taken, given, version, _ = self.sums.get()
        self.sums.update((events, taken, given, version + 1, 0))
        yield pd.DataFrame({"bucket": [key[0]], "providerKey": [key[1]], "events": [events], "input_tokens": [taken], "output_tokens": [given], "version": [version + 1]})

    def close(self) -> None:
        pass


def compacted(stream: DataFrame, delay: int = DELAY, remembered: int = REMEMBERED) -> DataFrame:
    """Wire events (dedupKey, providerKey, ts, inputTokens, outputTokens) to versions of buckets; the last one holds."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(X.bucket_start("ts").alias("bucket"), "providerKey", "dedupKey", "inputTokens", "outputTokens")
    return rows.groupBy("bucket", "providerKey").transformWithStateInPandas(Buckets(delay, remembered), COLUMNS, "Update", "ProcessingTime")


def bucket_sink(versions: DataFrame, table: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Writes versions under the number of their batch, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        out = batch.withColumns({"month": X.utc_month(F.col("bucket")), "batch": F.lit(number)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(table)

    return versions.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def buckets(spark: SparkSession, table: str) -> DataFrame:
    """The last version of each bucket."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("bucket", "providerKey").agg(F.max_by(F.struct("events", "input_tokens", "output_tokens", "version"), "version").alias("r"))
    return last.select("bucket", "providerKey", "r.*")
