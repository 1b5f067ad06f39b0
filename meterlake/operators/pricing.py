"""Prices over time: aliases, as-of lookup, intervals, finalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: vendors' prefixes of model names, the first that fits comes off; dated models behind a moving name.
PREFIXES = ("us.anthropic.", "anthropic.", "openai/", "bedrock/")
REVIEW = "codex-auto-review"
REVIEW_MODELS = [
    ("2025-08-07", "gpt-5"),
    ("2025-09-15", "gpt-5-codex"),
    ("2025-11-13", "gpt-5.1-codex"),
    ("2025-12-11", "gpt-5.2-codex"),
    ("2026-02-05", "gpt-5.3-codex"),
    ("2026-03-05", "gpt-5.4"),
    ("2026-04-23", "gpt-5.5"),
]
MODES = ("display", "auto", "calculate")


def aliases(models: DataFrame, keys: DataFrame) -> DataFrame:
    """models (model, each once) to price keys (model_id, each once): as it is, without a vendor's prefix, without an
    eight-digit date, else the longest key that contains it or is contained; both relations are lists of names."""
    plain = F.regexp_replace("model", "^(" + "|".join(re.escape(p) for p in PREFIXES) + ")", "")
    m = models.select("model", plain.alias("p"), F.regexp_replace(plain, r"-\d{8}$", "").alias("s"))
    names = m.select("model", F.posexplode(F.array("model", "p", "s")).alias("r", "model_id"))
    equal = names.join(keys.select("model_id"), "model_id").groupBy("model").agg(F.min_by("model_id", "r").alias("model_id"))
    # Only models that no key equals are held against all keys, as no equality can express a part of a name.
    rest, k = m.join(equal, "model", "left_anti"), F.col("model_id")
    part = rest.join(keys.select("model_id"), F.contains("p", k) | F.contains(k, "s"))
    best = part.groupBy("model").agg(F.min_by("model_id", F.struct(-F.length("model_id"), "model_id")).alias("model_id"))
    return equal.unionByName(best)


def segments(revisions: DataFrame) -> DataFrame:
    """Revisions as stretches of a model's time that don't overlap (s_from, s_until): in each the latest in effect that is
    still valid, where there is one.  Only revisions of one model meet each other."""
    edges = revisions.select("model_id", F.col("effective_at").alias("s_from")).unionByName(revisions.where("valid_until IS NOT NULL").select("model_id", F.col("valid_until").alias("s_from"))).distinct()
    spans = edges.withColumn("s_until", F.lead("s_from").over(Window.partitionBy("model_id").orderBy("s_from")))
    met = spans.join(revisions, "model_id").where((F.col("effective_at") <= F.col("s_from")) & (F.col("valid_until").isNull() | (F.col("s_from") < F.col("valid_until"))))
    return met.groupBy("model_id", "s_from", "s_until").agg(F.max_by(F.struct(*revisions.columns), F.struct("effective_at", "id")).alias("r"))


def as_of(events: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each event with the revision in force, the latest in effect that is still valid, or nulls.

    Stretches of a model don't overlap, so an event meets one at most: a join on the model with the period as a
    residual, and no grouping of events after it.  Catalyst broadcasts the stretches if their size allows it."""
    s = segments(revisions).withColumnRenamed("model_id", "s_model")
    on = (F.col("model") == F.col("s_model")) & (F.col("s_from") <= F.col("ts")) & (F.col("s_until").isNull() | (F.col("ts") < F.col("s_until")))
    return events.join(s, on, "left").select(*events.columns, *[F.col(f"r.{c}").alias(c if c not in ("id", "model_id") else f"revision_{c}") for c in revisions.columns])


def priced(events: DataFrame, revisions: DataFrame) -> DataFrame:
    """Cost by the revision in force; without one the cost is zero and the status unpriced."""
    out = as_of(events, revisions)
    cost = F.when(F.col("revision_id").isNotNull(), X.token_cost())
    return out.select(*events.columns, F.col("revision_id"), F.round(F.coalesce(cost, F.lit(0.0)), 9).alias("price"), F.when(cost.isNull(), "unpriced").otherwise("priced").alias("status"))


def intervals(snapshots: DataFrame) -> DataFrame:
    """Snapshots (model_id, observed_at, input, output) to change points with half-open validity."""
    w = Window.partitionBy("model_id").orderBy("observed_at")
    changed = snapshots.withColumn("was", F.lag(F.struct("input", "output")).over(w)).where(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.struct("input", "output")))
    return changed.select("model_id", F.col("observed_at").alias("valid_from"), F.lead("observed_at").over(w).alias("valid_until"), "input", "output")


def finalised(events: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Drops what is older than the limit at receipt and cleans hosts."""
    return events.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))).withColumn("host", X.clean_host(F.col("host")))


def pricing_model(model: Column, ts: Column, provider: Column, adapter: Column) -> Column:
    """The model that an event is priced as: the review model is the latest released by the event's UTC day, rollouts
    without a model count as the first of them."""
    day, first = F.to_date(ts), REVIEW_MODELS[0][1]
    dated = F.lit(first)
    for released, name in REVIEW_MODELS:
        dated = F.when(day >= F.lit(released).cast("date"), name).otherwise(dated)
    bare = model.isNull() & (provider == "codex") & (adapter == "codex")
    return F.when(model == REVIEW, dated).when(bare, first).otherwise(model)


def cost_by_mode(mode: str, given: Column, computed: Column) -> Column:
    """display: the given cost; auto: the given one, else the computed one; calculate: the computed one; else zero."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode!r}")
    return F.coalesce(*{"display": [given], "auto": [given, computed], "calculate": [computed]}[mode], F.lit(0.0))
