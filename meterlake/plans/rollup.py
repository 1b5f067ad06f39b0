"""Rollups and the planner that answers from them where they are complete.

A rollup row keeps every dimension that a distinct count needs, so measures over rollups equal measures over raw events.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

DIMENSIONS = ["provider_key", "user_id", "session_id", "model", "host", "cost_status"]
SUMS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "event_count"]
WIDTH = timedelta(minutes=15)


def compact(events: DataFrame, version: int = 1) -> DataFrame:
    """15-minute buckets by all dimensions; unpriced cost counts nothing."""
    cost = F.sum(F.when(F.col("cost_status") != "unpriced", F.col("cost_usd")).otherwise(0)).cast("decimal(28,8)").alias("cost_usd")
    return events.groupBy(X.bucket_start("ts").alias("ts"), *DIMENSIONS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS], cost, F.lit(version).cast("long").alias("version"))


def collapse(rows: DataFrame) -> DataFrame:
    """The last version of each bucket: a bucket that was compacted again replaces all its rows."""
    newest = rows.groupBy("ts").agg(F.max("version").alias("version"))
    return rows.join(newest, ["ts", "version"], "left_semi")


def local_rollup(quarter_hours: DataFrame, zone: str, unit: str = "day") -> DataFrame:
    """Local hours or days of a zone from 15-minute rows: every offset is a multiple of 15 minutes."""
    label = X.bucket_label("ts", zone, unit)
    return quarter_hours.groupBy(label.alias("bucket"), *DIMENSIONS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS], F.sum("cost_usd").alias("cost_usd"))


def daily(rows: DataFrame, *by: str) -> DataFrame:
    """15-minute rows summed by columns that they have got, and all dimensions."""
    return rows.groupBy(*by, *DIMENSIONS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS], F.sum("cost_usd").alias("cost_usd"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """Sums and an order-free hash of the compacted rows: raw events and rollup must agree."""
    c = compact(rows) if "version" not in rows.columns else rows
    h = F.bit_xor(F.xxhash64("ts", *[F.coalesce(F.col(d).cast("string"), F.lit("")) for d in DIMENSIONS], *SUMS, F.col("cost_usd").cast("string")))
    return c.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(s).cast("long").alias(s) for s in SUMS], h.alias("hash"))


def frontier(watermark: datetime, dirty: list[datetime]) -> datetime:
    """Up to where rollups may be read: the watermark or the first dirty bucket."""
    return min([watermark, *dirty])


def next_buckets(watermark: datetime, dirty: list[datetime], now: datetime, batch: int = 16, delay: timedelta = timedelta(minutes=30)) -> list[datetime]:
    """Work of a tick: dirty buckets first, for half the batch at most, then the next ones after the watermark that are old enough."""
    out = sorted(dirty)[: batch // 2]
    at = watermark
    while len(out) < batch and at + WIDTH <= now - delay:
        if at not in out:
            out.append(at)
        at += WIDTH
    return out


@dataclass(frozen=True)
class Plan:
    raw: tuple[tuple[datetime, datetime], ...]
    rollup: tuple[datetime, datetime] | None


def plan(start: datetime, end: datetime, watermark: datetime, dirty: list[datetime]) -> Plan:
    """raw [start, a) + rollup [a, b) + raw [b, end), with a and b on bucket edges and b below the frontier."""
    floor = lambda t: t - timedelta(seconds=t.timestamp() % WIDTH.total_seconds())
    a = floor(start)
    a = a if a == start else a + WIDTH
    b = floor(min(end, frontier(watermark, [d for d in dirty if d + WIDTH > start])))
    if b <= a:
        return Plan(((start, end),), None)
    return Plan(tuple((x, y) for x, y in ((start, a), (b, end)) if x < y), (a, b))


def stitched(events: DataFrame, rollup: DataFrame, p: Plan) -> DataFrame:
    """One relation over both, filters inside each branch; every aggregate over it equals that over raw events."""
    cols = ["ts", *DIMENSIONS, *SUMS, "cost_usd"]
    between = lambda df, x, y: df.where((F.col("ts") >= F.lit(x)) & (F.col("ts") < F.lit(y))).select(*cols)
    out = None
    for x, y in p.raw:
        part = between(events, x, y).withColumn("cost_usd", F.col("cost_usd").cast("decimal(28,8)"))
        out = part if out is None else out.unionByName(part)
    if p.rollup:
        part = between(collapse(rollup), *p.rollup)
        out = part if out is None else out.unionByName(part)
    return out


def ready_prefix(buckets: DataFrame, covered: DataFrame, dirty: DataFrame) -> DataFrame:
    """Of the buckets of a request (column ts, a bounded list), those before the first that isn't covered or is dirty."""
    b = buckets.join(covered.select("ts", F.lit(True).alias("c")).distinct(), "ts", "left").join(dirty.select("ts", F.lit(True).alias("d")).distinct(), "ts", "left")
    ok = F.col("c").isNotNull() & F.col("d").isNull()
    return b.withColumn("ready", F.bool_and(ok).over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))).where("ready").select("ts")


def advanced(watermark: datetime, committed: DataFrame, now: datetime, days: int = 400) -> DataFrame:
    """One row: the watermark after buckets (column bucket) were committed.  It moves over those that follow on without a
    gap, and is never more than `days` behind; of so many days the buckets are numbered in one task, 96 a day."""
    at = max(watermark, now - timedelta(days=days))
    at -= timedelta(seconds=at.timestamp() % WIDTH.total_seconds())
    ahead = committed.where((F.col("bucket") >= F.lit(at)) & (F.col("bucket") <= F.lit(now))).select("bucket").distinct()
    place = F.floor((F.unix_seconds("bucket") - F.lit(int(at.timestamp()))) / int(WIDTH.total_seconds()))
    joined = ahead.withColumn("n", F.row_number().over(Window.orderBy("bucket")) - 1).where(F.col("n") == place)
    return joined.agg((F.lit(at) + F.make_dt_interval(mins=(F.count(F.lit(1)) * 15).cast("int"))).alias("watermark"))


def final(rows: DataFrame, now: datetime, delay: timedelta = timedelta(minutes=30)) -> DataFrame:
    """Rows whose bucket ended so long ago that it may be compacted."""
    return rows.where(X.bucket_start("ts") + F.expr("interval 15 minutes") <= F.lit(now - delay))
