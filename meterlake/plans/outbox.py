"""Batches on their way to the store: claimed, delivered under a token, and claimed again if their worker was lost."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A batch in flight for so many seconds is taken for lost.
LOST = 5 * 60


def claimed(batches: DataFrame, now: datetime, limit: int) -> DataFrame:
    """All batches (batch_id, state, updated_at) after a claim by the one writer: the oldest that are pending, or in flight
    for too long, are in flight as of now; `claimed` marks them."""
    lost = (F.col("state") == "inflight") & (F.col("updated_at") < F.lit(now - timedelta(seconds=LOST)))
    oldest = batches.where((F.col("state") == "pending") | lost).orderBy("batch_id").limit(limit)
    met = batches.join(F.broadcast(oldest.select("batch_id", F.lit(True).alias("claimed"))), "batch_id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return met.withColumns({"state": F.when(F.col("claimed"), "inflight").otherwise(F.col("state")), "updated_at": F.when(F.col("claimed"), F.lit(now)).otherwise(F.col("updated_at"))})


def tokens(rows: DataFrame, key: str = "dedup_key") -> DataFrame:
    """batch_id and its token, which is the same whenever the same rows are delivered again, in any order.

    Keys are hashed one by one and combined by exclusive or and sum, so a batch of any size is never collected."""
    h = F.xxhash64(key)
    g = rows.groupBy("batch_id").agg(F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("rows"))
    return g.select("batch_id", F.sha2(F.concat_ws("|", "x", "s", "rows"), 256).alias("token"), "rows")


def delivered(batches: DataFrame, done: DataFrame) -> DataFrame:
    """All batches after a delivery (batch_id, ok): those in flight are delivered, or pending again after a failure."""
    met = batches.join(done.select("batch_id", "ok"), "batch_id", "left")
    mine = (F.col("state") == "inflight") & F.col("ok").isNotNull()
    return met.withColumn("state", F.when(mine & F.col("ok"), "delivered").when(mine, "pending").otherwise(F.col("state"))).select(*batches.columns)
