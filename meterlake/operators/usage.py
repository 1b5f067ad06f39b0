"""Scoped scans and the aggregates of the dashboards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


@dataclass(frozen=True)
class Scope:
    """A half-open period and what else must hold; an empty user list matches nothing."""

    start: str
    end: str
    provider: str | None = None
    user: int | None = None
    team: int | None = None
    users: tuple[int, ...] | None = None

    def predicate(self) -> Column:
        p = (F.col("ts") >= F.lit(self.start).cast("timestamp")) & (F.col("ts") < F.lit(self.end).cast("timestamp"))
        for name, value in (("provider_key", self.provider), ("user_id", self.user), ("team_id", self.team)):
            if value is not None:
                p &= F.col(name) == value
        return p if self.users is None else p & F.col("user_id").isin(*self.users)


def scan(events: DataFrame, scope: Scope) -> DataFrame:
    return events.where(scope.predicate())


def overview(src: DataFrame) -> DataFrame:
    """One row, also of nothing."""
    return src.agg(*X.measures())


def series(src: DataFrame, zone: str, bucket: str = "day", *by: str) -> DataFrame:
    return src.groupBy(X.bucket_label("ts", zone, bucket).alias("bucket"), *by).agg(*X.measures(False))


def breakdown(src: DataFrame, by: str, unknown: str | None = None) -> DataFrame:
    key = F.coalesce(F.col(by), F.lit(unknown)) if unknown else F.col(by)
    return src.groupBy(key.alias(by)).agg(*X.measures())


def bucket_by(src: DataFrame, zone: str, bucket: str, by: str, unknown: str) -> DataFrame:
    return src.groupBy(X.bucket_label("ts", zone, bucket).alias("bucket"), F.coalesce(by, F.lit(unknown)).alias(by)).agg(X.priced_cost().alias("cost"), F.coalesce(F.sum(X.total_tokens()), F.lit(0)).cast("long").alias("tokens"))


def leaderboard(src: DataFrame, labels: DataFrame, key: str, order: str = "cost", top: int = 100) -> DataFrame:
    """Null keys are left out; a key without a label is shown as itself; ties go by key.  The labels meet only the top rows."""
    sums = src.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(F.nullif("session_id", F.lit(""))).alias("sessions"), X.priced_cost().alias("cost"), F.sum(X.total_tokens()).cast("long").alias("tokens"), *X.coverage())
    best = sums.orderBy(F.desc(order), key).limit(top)
    return best.join(labels, key, "left").withColumn("label", F.coalesce("label", F.col(key).cast("string")))


def devices(src: DataFrame) -> DataFrame:
    return src.groupBy("host").agg(F.max("ts").cast("timestamp_ntz").alias("last_seen"), F.count(F.lit(1)).alias("events"))


def session_summaries(src: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return src.where(F.nullif("session_id", F.lit("")).isNotNull()).groupBy("session_id").agg(joined("model").alias("models"), joined("host").alias("hosts"), X.priced_cost().alias("cost"), *X.tokens(), *X.coverage())


def gap_filled(points: DataFrame, labels: DataFrame, zero: list[str]) -> DataFrame:
    """Every label of `labels` (column bucket), and any other of points; missing measures are zero."""
    out = labels.join(points, "bucket", "full")
    return out.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) if c in zero else F.col(c) for c in points.columns if c != "bucket"])


def heat_map(src: DataFrame, zone: str) -> DataFrame:
    """Tokens by weekday (Monday 0) and hour, with a level 0 to 3 by tertiles of the cells that aren't zero (168 at most)."""
    at = X.local("ts", zone)
    cells = src.groupBy(F.weekday(at).alias("weekday"), F.hour(at).alias("hour")).agg(F.sum(X.total_tokens()).cast("long").alias("tokens"))
    cuts = cells.where("tokens > 0").agg(F.sort_array(F.collect_list("tokens")).alias("v"))
    n = F.size("v")
    cuts = cuts.select(F.get("v", F.floor(n / 3).cast("int")).alias("a"), F.get("v", F.floor(2 * n / 3).cast("int")).alias("b"))
    t = F.col("tokens")
    return cells.crossJoin(F.broadcast(cuts)).select("weekday", "hour", "tokens", F.when(t <= 0, 0).when(t <= F.col("a"), 1).when(t <= F.col("b"), 2).otherwise(3).alias("level"))


def top_and_other(src: DataFrame, zone: str, top: int = 3) -> DataFrame:
    """Tokens of the largest models by bucket, the others together."""
    name = F.coalesce("model", F.lit("(unknown)"))
    sums = src.groupBy(X.bucket_label("ts", zone).alias("bucket"), name.alias("model")).agg(F.sum(X.total_tokens()).cast("long").alias("tokens"))
    best = sums.groupBy("model").agg(F.sum("tokens").alias("all")).orderBy(F.desc("all"), "model").limit(top).select("model", F.lit(True).alias("best"))
    shown = sums.join(F.broadcast(best), "model", "left").select("bucket", F.when(F.col("best"), F.col("model")).otherwise("other").alias("model"), "tokens")
    return shown.groupBy("bucket", "model").agg(F.sum("tokens").cast("long").alias("tokens"))


def peak(points: DataFrame, by: str) -> DataFrame:
    """The first bucket with the highest value."""
    return points.orderBy(F.desc(by), "bucket").limit(1)


def members_and_others(src: DataFrame, zone: str, top: int) -> DataFrame:
    """Tokens of the largest users in every bucket, zero where they have none, and of all others together (member null)."""
    sums = src.groupBy(X.bucket_label("ts", zone).alias("bucket"), "user_id").agg(F.sum(X.total_tokens()).cast("long").alias("tokens"))
    best = sums.groupBy("user_id").agg(F.sum("tokens").alias("all")).orderBy(F.desc("all"), "user_id").limit(top).select("user_id", F.col("user_id").alias("member"))
    shown = sums.join(F.broadcast(best), "user_id", "left").groupBy("bucket", "member").agg(F.sum("tokens").alias("tokens"))
    everyone = best.select("member").unionByName(best.sparkSession.createDataFrame([(None,)], "member bigint"))
    grid = sums.select("bucket").distinct().crossJoin(F.broadcast(everyone)).select(F.col("bucket").alias("b"), F.col("member").alias("m"))
    met = grid.join(shown, (F.col("b") == F.col("bucket")) & F.col("m").eqNullSafe(F.col("member")), "left")
    return met.select(F.col("b").alias("bucket"), F.col("m").alias("member"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
