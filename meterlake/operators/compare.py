"""Two periods side by side: tagging, summaries, composition, insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .usage import Scope

MIN_SESSIONS, RATE, SHARE, TOLERANCE = 5, 10.0, 5.0, 1e-9


def tagged(events: DataFrame, current: Scope, previous: Scope) -> DataFrame:
    """One scan of both periods; a row is in one of them."""
    c, p = current.predicate(), previous.predicate()
    return events.where(c | p).withColumn("period", F.when(c, "current").otherwise("previous"))


def summary_and_trend(both: DataFrame, zone: str, current_start: str, previous_start: str) -> DataFrame:
    """Totals by period (position null) and by local-day offset from the period's start, in one pass of grouping sets."""
    start = F.when(F.col("period") == "current", F.lit(current_start)).otherwise(F.lit(previous_start)).cast("timestamp")
    days = both.withColumn("position", F.datediff(X.local("ts", zone), X.local(start, zone)))
    return days.groupingSets([["period"], ["period", "position"]], "period", "position").agg(*X.measures())


def composition(both: DataFrame) -> DataFrame:
    """Cost and tokens of models and providers in either period; a missing side is zero."""
    rows = both.withColumn("model", F.coalesce("model", F.lit("(unknown)")))
    sums = rows.groupingSets([["period", "model"], ["period", "provider_key"]], "period", "model", "provider_key").agg(F.grouping("model").alias("g"), F.sum(F.when(F.col("cost_status") != "unpriced", F.col("cost_usd"))).cast("double").alias("c"), F.sum(X.total_tokens()).alias("t"))
    side = lambda v, p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col(v))), F.lit(0))
    out = sums.groupBy(F.when(F.col("g") == 0, "model").otherwise("provider").alias("dimension"), F.coalesce("model", "provider_key").alias("key"))
    return out.agg(*[f for p in ("current", "previous") for f in (F.round(side("c", p).cast("double"), 4).alias(f"{p}_cost"), side("t", p).cast("long").alias(f"{p}_tokens"))])


def insights(totals: DataFrame, parts: DataFrame, top: int = 3) -> DataFrame:
    """Token insights of one comparison: totals has a row per period (sessions, tokens), parts comes from composition()."""
    at = lambda c, p: F.coalesce(F.max(F.when(F.col("period") == p, F.col(c))), F.lit(0))
    t = totals.agg(*[at(c, p).alias(f"{c}_{p}") for c in ("sessions", "tokens") for p in ("current", "previous")])
    fresh = (F.col("sessions_previous") == 0) & (F.col("sessions_current") > 0)
    enough = (F.col("sessions_current") >= MIN_SESSIONS) & (F.col("sessions_previous") >= MIN_SESSIONS)
    pick = ["rule", "name", "score", "turn"]
    new = t.where(fresh).select(F.lit("usage.new").alias("rule"), F.lit("").alias("name"), F.lit(100.0).alias("score"), F.lit(0).alias("turn"))
    out = new
    for i, c in enumerate(("sessions", "tokens")):
        d = (F.col(f"{c}_current") - F.col(f"{c}_previous")) / F.nullif(F.col(f"{c}_previous"), F.lit(0)) * 100
        rows = t.where(~fresh & enough & (F.abs(d) + TOLERANCE >= RATE))
        out = out.unionByName(rows.select(F.when(d > 0, f"{c}.increase").otherwise(f"{c}.decrease").alias("rule"), F.lit("").alias("name"), F.abs(d).alias("score"), F.lit(i + 1).alias("turn")))
    both = parts.crossJoin(F.broadcast(t)).where(~fresh)
    turn = F.when(F.col("dimension") == "model", 3).otherwise(4)
    name = F.concat_ws(":", "dimension", "key")
    first = (F.col("previous_tokens") == 0) & (F.col("current_tokens") > 0)
    out = out.unionByName(both.where(first).select(F.lit("composition.new").alias("rule"), name.alias("name"), F.lit(100.0).alias("score"), turn.alias("turn")))
    d = (F.col("current_tokens") / F.nullif("tokens_current", F.lit(0)) - F.col("previous_tokens") / F.nullif("tokens_previous", F.lit(0))) * 100
    out = out.unionByName(both.where(~first & enough & (F.abs(d) + TOLERANCE >= SHARE)).select(F.when(d > 0, "composition.increase").otherwise("composition.decrease").alias("rule"), name.alias("name"), F.abs(d).alias("score"), turn.alias("turn")))
    return out.select(*pick).orderBy(F.desc("score"), "turn", "name").limit(top).select("rule", "name", F.round("score", 6).alias("score"))


def share_changes(parts: DataFrame, top: int = 5) -> DataFrame:
    """The parts of one dimension whose share of tokens changed most, in percentage points."""
    t = parts.agg(*[F.sum(f"{p}_tokens").alias(p) for p in ("current", "previous")])
    share = lambda p: F.coalesce(F.col(f"{p}_tokens") / F.nullif(F.col(p), F.lit(0)) * 100, F.lit(0.0))
    x = parts.where("current_tokens > 0 OR previous_tokens > 0").crossJoin(F.broadcast(t)).select("key", share("current").alias("a"), share("previous").alias("b"))
    best = x.orderBy(F.desc(F.abs(F.col("a") - F.col("b"))), "key").limit(top)
    return best.select("key", F.round("a", 6).alias("current_share"), F.round("b", 6).alias("previous_share"), F.round(F.col("a") - F.col("b"), 6).alias("delta"))
