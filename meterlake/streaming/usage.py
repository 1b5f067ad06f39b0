"""Streaming ingest: wire events from files, idempotent by key however late, into raw rows and late-safe buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs as X
from ..sources.logs import wire_events


def wire_stream(spark: SparkSession, path: str) -> DataFrame:
    """Sound events, late ones and repeated keys included: raw_sink passes over keys that were said before."""
    lines = spark.readStream.schema("value string").text(path)
    return wire_events(lines).where("error IS NULL")


def quarter_hours(stream: DataFrame, late: str = "30 minutes") -> DataFrame:
    """15-minute windows that are closed by the watermark (append mode); a key said again within it counts once."""
    stream = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["dedupKey"])
    return stream.groupBy(F.window("ts", "15 minutes"), "providerKey").agg(F.count(F.lit(1)).alias("events"), F.sum("inputTokens").alias("input_tokens")).select(F.col("window.start").alias("bucket"), "providerKey", "events", "input_tokens")


def raw_sink(stream: DataFrame, table: str, dirty: str, checkpoint: str) -> StreamingQuery:
    """Appends keys that the table doesn't have, one event of each, and the buckets that each batch touched.  A batch is
    written under its number, so that one that is run again replaces itself.  The table is partitioned by the day (in UTC)
    of its events first, and a batch meets the keys of its own days only, so its cost doesn't grow with the table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sent = batch.dropDuplicates(["dedupKey"]).withColumn("day", F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyyMMdd").cast("int"))
        sent.persist()
        days = [r.day for r in sent.select("day").distinct().collect()]
        try:
            had = spark.read.parquet(table).where(F.col("day").isin(days) & (F.col("batch") != number)).select("dedupKey")
            batch = sent.join(had, "dedupKey", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            batch = sent
        batch = batch.withColumn("batch", F.lit(number))
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(table)
        batch.select(X.bucket_start("ts").alias("bucket"), "batch").distinct().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(dirty)
        sent.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
