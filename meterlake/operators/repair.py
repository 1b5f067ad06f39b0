"""Repair of prices, rollups and teams: what to change is computed as a relation, never row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import pricing

STATUSES = ("priced", "unpriced", "legacy")
_START, _END = "0001-01-01", "9999-12-31"


def price_candidates(events: DataFrame, weak: DataFrame | None = None) -> DataFrame:
    """Events without a sound price: unpriced, legacy, or priced by a revision of `weak` (revision_id)."""
    sound = F.col("cost_status") == "priced"
    if weak is None:
        return events.where(~sound)
    by_weak = events.where(sound).join(weak.select("revision_id"), "revision_id", "left_semi").select(*events.columns)
    return events.where(~sound).unionByName(by_weak)


def price_repair(events: DataFrame, revisions: DataFrame, weak: DataFrame | None = None) -> DataFrame:
    """Candidates with the price in force and an outcome: unpriced still, recovered, repriced, or same."""
    priced = pricing.priced(price_candidates(events, weak).drop("revision_id"), revisions)
    now, was = F.col("status"), F.col("cost_status")
    moved = (was != "priced") | (F.round(F.col("cost_usd").cast("double"), 8) != F.round("price", 8))
    return priced.withColumn("outcome", F.when(now == "unpriced", "unpriced").when(was == "unpriced", "recovered").when(moved, "repriced").otherwise("same"))


def bucket_state(rows: DataFrame) -> DataFrame:
    """Events by cost status and the cost of each 15-minute bucket, of raw events or of rollup rows alike."""
    n = [F.sum(F.when(F.col("cost_status") == s, F.col("event_count")).otherwise(0)).cast("long").alias(s) for s in STATUSES]
    cost = F.sum(F.when(F.col("cost_status") != "unpriced", F.col("cost_usd")).otherwise(0)).cast("decimal(28,8)").alias("cost")
    return rows.groupBy(X.bucket_start("ts").alias("bucket")).agg(F.sum("event_count").cast("long").alias("events"), *n, cost)


def stale_buckets(events: DataFrame, rollup: DataFrame, dirty: DataFrame) -> DataFrame:
    """Buckets whose rollup has all events but other statuses or another cost, and that aren't dirty already."""
    raw, kept = bucket_state(events), bucket_state(rollup)
    kept = kept.select("bucket", *[F.col(c).alias(f"kept_{c}") for c in kept.columns if c != "bucket"])
    differs = F.lit(False)
    for c in (*STATUSES, "cost"):
        differs |= ~F.col(c).eqNullSafe(F.col(f"kept_{c}"))
    met = raw.join(kept, "bucket").where((F.col("events") == F.col("kept_events")) & differs)
    return met.join(dirty, "bucket", "left_anti").select("bucket")


def team_backfill(events: DataFrame, user: int, team: int, start: str, end: str) -> DataFrame:
    """Events with the user's rows of a period that have no team given one; `filled` marks them."""
    hit = (F.col("user_id") == user) & F.col("team_id").isNull() & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))
    return events.withColumn("filled", F.coalesce(hit, F.lit(False))).withColumn("team_id", F.when(F.col("filled"), F.lit(team).cast("long")).otherwise(F.col("team_id")))


def moved_members(assignments: DataFrame, moves: DataFrame) -> DataFrame:
    """Memberships after moves (user_id, team_id, at; one a user): the open interval ends at the move and a new one starts;
    a user without any membership has the new one from the beginning."""
    m = moves.select("user_id", F.col("team_id").alias("to_team"), "at")
    kept = assignments.join(m, "user_id", "left").withColumn("effective_to", F.coalesce("effective_to", "at")).select(*assignments.columns)
    seen = assignments.select("user_id").distinct().withColumn("seen", F.lit(True))
    new = m.join(seen, "user_id", "left").select("user_id", F.col("to_team").alias("team_id"), F.when(F.col("seen"), F.col("at")).alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"))
    return kept.unionByName(new.select(*assignments.columns))


def changed_prices(prices: DataFrame, revisions: DataFrame, columns: list[str]) -> DataFrame:
    """Prices (model_id and columns) that differ from the model's latest revision, or whose model has none."""
    last = revisions.groupBy("model_id").agg(F.max_by(F.struct(*columns), F.struct("effective_at", "id")).alias("last"))
    now = F.struct(*[F.col(c) for c in columns])
    return prices.join(last, "model_id", "left").where(F.col("last").isNull() | ~now.eqNullSafe(F.col("last"))).select(*prices.columns)


def history_intervals(snapshots: DataFrame, start: str) -> DataFrame:
    """As `pricing.intervals`; the first price of a model holds from the start of the range."""
    first = F.min("valid_from").over(Window.partitionBy("model_id"))
    x = pricing.intervals(snapshots)
    return x.withColumn("valid_from", F.when(F.col("valid_from") == first, F.least("valid_from", F.lit(start).cast("timestamp"))).otherwise(F.col("valid_from")))


def counters(state: DataFrame, before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counters (keys, n) with rows changed from `before` to `after` moved over; `sound` is false where one falls below zero."""
    signed = lambda df, s: df.select(*keys, F.lit(s).cast("long").alias("n"))
    total = state.select(*keys, "n").unionByName(signed(before, -1)).unionByName(signed(after, 1)).groupBy(*keys).agg(F.sum("n").alias("n"))
    return total.where("n <> 0").withColumn("sound", F.col("n") >= 0)
