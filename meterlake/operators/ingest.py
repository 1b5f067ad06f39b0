"""Ingest and repair as set operations: idempotent insert, versions, marts, deletion, reconciliation, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def new_rows(batch: DataFrame, existing: DataFrame, key: str = "dedup_key", order: str = "event_id") -> DataFrame:
    """First writer wins: one row of each key of the batch, if the table has none."""
    first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    return first.join(existing.select(key), key, "left_anti").select(*batch.columns)


def latest(rows: DataFrame, key: str = "dedup_key", version: str = "version") -> DataFrame:
    """Last version wins."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")


def added(mart: DataFrame, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """A mart with a batch's sums added."""
    return mart.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums])


def daily_mart(events: DataFrame, zone: str, key: str) -> DataFrame:
    return events.where(F.col(key).isNotNull()).groupBy(X.bucket_label("ts", zone).alias("day"), key, "provider_key").agg(F.countDistinct("session_id").alias("sessions"), X.priced_cost().alias("cost"), *X.tokens(), F.sum("event_count").cast("long").alias("events"))


def rewrite_days(spark, mart: DataFrame, path: str) -> None:
    """Replaces the days of a mart partitioned by day, and no others."""
    mart.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def dirty_buckets(rows: DataFrame) -> DataFrame:
    return rows.select(X.bucket_start("ts").alias("bucket")).distinct()


def without_keys(events: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return events.join(keys, on, "left_anti")


def replayed(events: DataFrame) -> DataFrame:
    """Unpriced rows without a model that have a twin with one: same user, session, host, time and counts, null-safe."""
    cols = ["user_id", "session_id", "host", "ts", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]
    bare = events.where("model IS NULL AND cost_status = 'unpriced'")
    full = events.where("model IS NOT NULL").select(*[F.col(c).alias(f"t_{c}") for c in cols]).distinct()
    on = None
    for c in cols:
        p = F.col(c).eqNullSafe(F.col(f"t_{c}"))
        on = p if on is None else on & p
    return bare.join(full, on, "left_semi")


def attributed(events: DataFrame, assignments: DataFrame) -> DataFrame:
    """Team valid at event time, null in a gap: hash join on the user, the interval as a residual."""
    a = assignments.select(F.col("user_id").alias("a_user"), "team_id", "effective_from", "effective_to")
    on = (F.col("user_id") == F.col("a_user")) & (F.col("effective_from").isNull() | (F.col("effective_from") <= F.col("ts"))) & (F.col("effective_to").isNull() | (F.col("ts") < F.col("effective_to")))
    return events.join(a, on, "left").drop("a_user", "effective_from", "effective_to")


def overlapping(assignments: DataFrame) -> DataFrame:
    """Users whose intervals overlap, which must be none: by neighbours in order, not by pairs."""
    w = Window.partitionBy("user_id").orderBy(F.col("effective_from").asc_nulls_first())
    far = F.coalesce(F.col("effective_to"), F.lit("9999-12-31").cast("timestamp"))
    before = F.max(far).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return assignments.where(F.lit(True)).withColumn("before", before).where(F.coalesce(F.col("effective_from"), F.lit("0001-01-01").cast("timestamp")) < F.col("before")).select("user_id").distinct()


def unattributed(events: DataFrame) -> DataFrame:
    t = events.where("team_id IS NULL")
    return t.agg(F.count(F.lit(1)).alias("events"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"), F.coalesce(F.sum(X.total_tokens()), F.lit(0)).cast("long").alias("tokens"), X.priced_cost().alias("cost"))


def diagnostics(events: DataFrame) -> DataFrame:
    return events.where("cost_status <> 'priced'").groupBy("provider_key", "model").agg(*X.coverage(), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))
