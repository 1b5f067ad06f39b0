"""Tool activity: outcomes, recovery after failure, and the utilisation index built on them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import timeutil

WINDOW_SECONDS = 30 * 60


def outcomes() -> list:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return [F.count(F.lit(1)).alias("calls"), *[n(o).alias(f"{o}_calls") for o in ("success", "failure", "unknown")]]


def summary(tools: DataFrame) -> DataFrame:
    """One row; pairs of user and host count also where the host is null."""
    return tools.agg(*outcomes(), F.countDistinct(F.when(F.col("activity_kind") == "skill", F.col("item_key"))).alias("skills"), F.countDistinct(F.struct("user_id", "host")).alias("devices"))


def table(tools: DataFrame) -> DataFrame:
    return tools.groupBy("activity_kind", "item_key").agg(*outcomes(), F.max("ts").cast("timestamp_ntz").alias("last_seen"), F.array_join(F.sort_array(F.collect_set("host")), ",").alias("hosts"))


def with_previous(tools: DataFrame) -> DataFrame:
    """Each call with what came before it in its session for the same item; `near` if within half an hour.  A session of
    null has no before."""
    w = Window.partitionBy("user_id", "session_id", "activity_kind", "item_key").orderBy("ts", "event_id")
    out = tools.withColumn("was", F.lag("outcome").over(w)).withColumn("was_ts", F.lag("ts").over(w))
    near = F.col("session_id").isNotNull() & (F.unix_micros("ts") - F.unix_micros("was_ts") <= WINDOW_SECONDS * 1_000_000)
    return out.withColumn("near", F.coalesce(near, F.lit(False)))


def of_days(rows: DataFrame, zone: str, first: str, end: str, before: int = 0) -> DataFrame:
    """Rows of a half-open range of local days, and of so many seconds before, by a filter that reaches the scan.  A call is
    near another of WINDOW_SECONDS before it at most, so recovery needs no earlier ones."""
    a, b = (timeutil.first_instant(date.fromisoformat(x), zone) for x in (first, end))
    return rows.where((F.col("ts") >= F.lit(a - timedelta(seconds=before))) & (F.col("ts") < F.lit(b)))


def reliability_days(tools: DataFrame, zone: str) -> DataFrame:
    t, failed, near = with_previous(tools), F.col("was") == "failure", F.col("near")
    n = F.count_if
    return t.groupBy("user_id", X.bucket_label("ts", zone).alias("day")).agg(
        *outcomes(),
        F.countDistinct("item_key").alias("distinct_tools"),
        F.countDistinct("session_id").alias("tool_sessions"),
        n(near & failed & (F.col("outcome") == "failure")).alias("repeated_failures"),
        n(near & failed & F.col("outcome").isin("success", "failure")).alias("recovery_attempts"),
        n(near & failed & (F.col("outcome") == "success")).alias("recoveries"),
    )


def usage_days(events: DataFrame, zone: str, capable: list[str]) -> DataFrame:
    """User and local day: sessions, and cache tokens of providers that report them."""
    can = F.col("provider_key").isin(*capable)
    s = lambda c: F.coalesce(F.sum(F.when(can, F.col(c))), F.lit(0)).cast("long").alias(c)
    return events.groupBy("user_id", X.bucket_label("ts", zone).alias("day")).agg(F.countDistinct("session_id").alias("sessions"), s("input_tokens"), s("cache_read_tokens"), s("cache_creation_tokens"), F.count_if(can).alias("signal_events"), F.count_if(~can).alias("unsupported_events"))


def merged_days(usage: DataFrame, tools: DataFrame) -> DataFrame:
    """Full outer by user and day; what is missing is zero."""
    out = usage.join(tools, ["user_id", "day"], "full")
    return out.na.fill(0)


def stacked_days(usage: DataFrame, tools: DataFrame) -> DataFrame:
    """What `personal` takes, without a join: as it sums days and takes rates from either side alone, a day may have a row
    of each."""
    return usage.unionByName(tools, allowMissingColumns=True).na.fill(0)


def personal(days: DataFrame, current: tuple[str, str], baseline: tuple[str, str]) -> DataFrame:
    """The utilisation index of each user: half-open ranges of local days.  All by one grouping on the user."""
    c, d = F.col, F.col("day")
    now, then = (d >= current[0]) & (d < current[1]), (d >= baseline[0]) & (d < baseline[1])
    known, all_calls = c("success_calls") + c("failure_calls"), c("success_calls") + c("failure_calls") + c("unknown_calls")
    seen = c("input_tokens") + c("cache_read_tokens") + c("cache_creation_tokens")
    rate = F.when((c("signal_events") > 0) & (seen > 0), c("cache_read_tokens") / seen)
    works = F.when(known > 0, c("success_calls") / known)
    both = {"cur": now, "base": then}
    aggs = []
    for p, on in both.items():
        s = lambda x, on=on: F.coalesce(F.sum(F.when(on, x)), F.lit(0))
        aggs += [F.count_if(on & (c("sessions") > 0)).alias(f"{p}_days"), s(c("sessions")).alias(f"{p}_sessions"), s(known).alias(f"{p}_known"), s(all_calls).alias(f"{p}_calls")]
        aggs += [s(c("signal_events")).alias(f"{p}_signal"), s(c("unsupported_events")).alias(f"{p}_unsupported")]
        aggs += [F.collect_list(F.when(on, rate)).alias(f"{p}_rates"), F.collect_list(F.when(on, works)).alias(f"{p}_works")]
    g = days.where(now | then).groupBy("user_id").agg(*aggs)
    share = lambda p: F.when(c(f"{p}_calls") > 0, c(f"{p}_known") / c(f"{p}_calls")).otherwise(0.0)
    signal, unsupported = c("cur_signal") + c("base_signal"), c("cur_unsupported") + c("base_unsupported")
    context_reason = F.when((signal == 0) & (unsupported > 0), "unsupported_cache_signal").when((F.size("cur_rates") < 3) | (F.size("base_rates") < 7), "insufficient_context_days")
    work_reason = F.when((c("cur_known") < 10) | (c("base_known") < 10), "insufficient_known_tool_calls").when((share("cur") < 0.7) | (share("base") < 0.7), "low_tool_outcome_coverage").when((F.size("base_works") < 7) | (F.size("cur_works") < 2), "insufficient_tool_days")
    g = g.withColumn("context_reason", context_reason).withColumn("execution_reason", work_reason)
    g = g.withColumn("context_score", F.when(c("context_reason").isNull(), X.baseline_score(X.array_median(c("cur_rates")), c("base_rates"))))
    g = g.withColumn("execution_score", F.when(c("execution_reason").isNull(), X.baseline_score(X.array_median(c("cur_works")), c("base_works"))))
    two = c("context_score").isNotNull() & c("execution_score").isNotNull()
    early = F.array_compact(F.array(F.when(c("cur_days") < 3, "insufficient_current_days"), F.when(c("cur_sessions") < 5, "insufficient_current_sessions"), F.when(c("base_days") < 7, "insufficient_baseline_days")))
    score = F.when((F.size(early) == 0) & two, X.js_round((c("context_score") + c("execution_score")) / 2)).cast("long")
    spare = F.when(signal + unsupported > 0, unsupported / (signal + unsupported)).otherwise(0.0)
    high = score.isNotNull() & (c("base_days") >= 14) & (share("cur") >= 0.9) & (share("base") >= 0.9) & (spare <= 0.1)
    reasons = F.concat(early, F.array_compact(F.array(F.when(~two, "insufficient_valid_dimensions"))))
    return g.select("user_id", score.alias("score"), F.when(high, "high").when(score.isNull(), "low").otherwise("medium").alias("confidence"), "context_score", "execution_score", "context_reason", "execution_reason", F.array_join(reasons, ",").alias("reasons"), c("cur_days").cast("long").alias("active_days"), c("cur_sessions").cast("long").alias("sessions"))


def baseline_scores(rows: DataFrame, key: str, value: str, current: str) -> DataFrame:
    """key and score of each key: its largest `current` against the median of its values and their median deviation from that.

    Equal values of a key are counted before they meet, so a key's rows may be any number; its distinct values are in one
    task."""
    counts = rows.groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.max(current).alias("c"))
    whole = Window.partitionBy(key)
    placed = counts.withColumn("center", F.percentile("v", F.lit(0.5), F.col("n")).over(whole)).withColumn("c", F.max("c").over(whole))
    g = placed.groupBy(key).agg(F.first("center").alias("center"), F.first("c").alias("c"), F.percentile(F.abs(F.col("v") - F.col("center")), F.lit(0.5), F.col("n")).alias("spread"))
    return g.select(key, X.deviation_score(F.col("c"), F.col("center"), F.col("spread")).alias("score"))


def organisation(scores: DataFrame, least: int = 5) -> DataFrame:
    """Median, quartiles by nearest rank and bands; fewer than `least` active users are suppressed, fewer than `least` scores
    insufficient.  Scores are whole numbers up to 100, so users are counted by score and ranks come from 101 rows at most."""
    s, n = F.col("score"), F.col("n")
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("active_days") > 0).alias("a"))
    total = lambda on: F.coalesce(F.sum(F.when(on, n)), F.lit(0)).cast("long")
    g = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("active"), total(s.isNotNull()).alias("eligible"), F.sort_array(F.collect_list(F.when(s.isNotNull(), F.struct("score", "n")))).alias("v"), total(s >= 56).alias("above"), total(s.between(45, 55)).alias("usual"), total(s <= 44).alias("below"))
    last = F.col("eligible") - 1
    start = lambda k: F.struct(k.cast("long").alias("left"), F.lit(None).cast("long").alias("hit"))
    ranked = lambda k: F.aggregate("v", start(k), lambda a, x: F.struct((a["left"] - x["n"]).alias("left"), F.coalesce(a["hit"], F.when(a["left"] < x["n"], x["score"].cast("long"))).alias("hit")))["hit"]
    median = (ranked(F.floor(last / 2)) + ranked(F.ceil(last / 2))) / 2
    quartile = lambda share: ranked(F.floor(last * share + 0.5)).cast(scores.schema["score"].dataType)
    state = F.when(F.col("active") < least, "suppressed").when(F.col("eligible") < least, "insufficient").otherwise("ready")
    ready = lambda x: F.when(state == "ready", x)
    return g.select("active", "eligible", state.alias("state"), ready(median).cast("double").alias("median"), ready(quartile(0.25)).alias("p25"), ready(quartile(0.75)).alias("p75"), *[ready(F.col(c)).alias(c) for c in ("above", "usual", "below")])
