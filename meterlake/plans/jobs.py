"""Work on rollups: which jobs a change invalidates, which runs next, how large a batch is, when reads switch over."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeutil
from ..functions.exprs import bucket_label, first_instant

#: Fixed values of scheduling, in seconds.
CADENCE, REPAIR_CADENCE, STARVED = 60, 10, 120
ORDER = ("validation", "pricing_repair", "quarter_hours", "zones")
HEALTHY, STEP, REVALIDATE, FAILURES = 3600, 60, 6 * 3600, 3
SLOW_MS, FAST_MS = 10_000, 2_000


def affected_jobs(buckets: DataFrame, zones: list[str]) -> DataFrame:
    """Local hours and days of each zone that changed 15-minute buckets (column bucket) fall into, each once."""
    one = lambda z, u: F.struct(F.lit(z).alias("zone"), F.lit(u).alias("unit"), bucket_label("bucket", z, u).alias("label"))
    return buckets.select(F.inline(F.array(*[one(z, u) for z in zones for u in ("hour", "day")]))).distinct()


def invalidated(jobs: DataFrame, affected: DataFrame) -> DataFrame:
    """Jobs (zone, unit, label, state, generation): affected ones are pending again in the next generation, new ones are added."""
    met = jobs.join(affected.withColumn("hit", F.lit(True)), ["zone", "unit", "label"], "full")
    return met.select("zone", "unit", "label", F.when(F.col("hit"), "pending").otherwise(F.col("state")).alias("state"), (F.coalesce("generation", F.lit(0)) + F.when(F.col("hit"), 1).otherwise(0)).cast("long").alias("generation"))


def prewarm(today: date, zone: str, days: int = 400, hour_days: int = 32, chunk: int = 16) -> list[tuple[str, datetime, datetime]]:
    """Chunks of (unit, from, to) in UTC: local days, and of the last days all hours, the newest first."""
    at = lambda n: timeutil.first_instant(today - timedelta(days=n), zone)
    out = [("day", at(min(n + chunk, days) - 1), at(n - 1)) for n in range(0, days, chunk)]
    end, start, hours = at(-1), at(hour_days - 1), timedelta(hours=chunk)
    while end > start:
        out.append(("hour", max(start, end - hours), end))
        end -= hours
    return out


def prewarm_windows(zones: DataFrame, days: int = 400, hour_days: int = 32, chunk: int = 16) -> DataFrame:
    """`prewarm` of many zones and days (id, zone, today) at once: id, unit, start and end."""
    at = lambda n: first_instant(F.date_sub("today", n), F.col("zone"))
    by_day = zones.select("id", "zone", "today", F.explode(F.sequence(F.lit(0), F.lit(days - 1), F.lit(chunk))).alias("n"))
    by_day = by_day.select("id", F.lit("day").alias("unit"), at(F.least(F.col("n") + chunk, F.lit(days)) - 1).alias("start"), at(F.col("n") - 1).alias("end"))
    hours = F.make_dt_interval(hours=F.lit(chunk))
    span = zones.select("id", at(F.lit(hour_days - 1)).alias("low"), at(F.lit(-1)).alias("high"))
    by_hour = span.select("id", "low", F.explode(F.sequence(F.col("high"), F.col("low") + F.expr("interval 1 second"), -hours)).alias("end"))
    by_hour = by_hour.select("id", F.lit("hour").alias("unit"), F.greatest("low", F.col("end") - hours).alias("start"), "end")
    return by_day.unionByName(by_hour)


@dataclass(frozen=True)
class Candidate:
    task: str
    due: bool = True
    next_attempt: datetime | None = None
    last_started: datetime | None = None
    eligible_since: datetime | None = None


def next_task(candidates: list[Candidate], now: datetime) -> str | None:
    """Validation first, then whoever waited too long, then the least recently started, then the fixed order."""

    def ready(c: Candidate) -> bool:
        wait = REPAIR_CADENCE if c.task == "pricing_repair" else CADENCE
        rested = c.last_started is None or (now - c.last_started).total_seconds() >= wait
        return c.due and rested and (c.next_attempt is None or c.next_attempt <= now)

    def urgency(c: Candidate) -> tuple:
        starved = c.eligible_since is not None and (now - c.eligible_since).total_seconds() >= STARVED
        begun = c.last_started.timestamp() if c.last_started else float("-inf")
        return (c.task != "validation", not starved, begun, ORDER.index(c.task))

    return min(filter(ready, candidates), key=urgency, default=Candidate("")).task or None


def next_limit(limit: int, processed: int, duration_ms: int, failed: bool, least: int, most: int) -> int:
    """Half as many after a failure or a slow batch, a quarter more after a full fast one, always within the bounds."""
    limit = min(most, max(least, limit))
    if failed or duration_ms >= SLOW_MS:
        return max(least, floor(limit / 2))
    return min(most, ceil(limit * 1.25)) if processed >= limit and duration_ms <= FAST_MS else limit


@dataclass(frozen=True)
class Progress:
    percent: float
    completed: int
    total: int
    remaining: int
    eta_minutes: int | None


def progress(start: datetime, end: datetime, watermark: datetime | None, dirty: list[datetime], per_minute: float = 0, width: timedelta = timedelta(minutes=15)) -> Progress:
    """Buckets of [start, end) done up to the watermark; dirty ones that aren't ahead of it anyway remain as well."""
    total = ceil(max(end - start, timedelta()) / width)
    edge = start if watermark is None else min(end, max(start, watermark))
    ahead = max(0, floor((end - edge) / width))
    again = sum(1 for d in set(dirty) if start <= d < end and not ((d - edge) % width == timedelta() and 0 <= (d - edge) // width < ahead))
    left, done = ahead + again, max(0, total - ahead)
    eta = 0 if left == 0 else ceil(left / per_minute) if per_minute > 0 else None
    return Progress(round(100 * done / total, 1) if total else 100.0, done, total, left, eta)


def progress_of(states: DataFrame, dirty: DataFrame, minutes: int = 15) -> DataFrame:
    """`progress` of many: states (id, start, end, watermark, per_minute), dirty (id, bucket)."""
    width, micros = minutes * 60_000_000, F.unix_micros
    s = states.select("id", "per_minute", micros("start").alias("a"), micros("end").alias("b"), F.coalesce(F.least("end", F.greatest("start", F.nvl2("watermark", F.col("watermark"), F.col("start")))), "start").alias("edge"))
    s = s.withColumn("edge", micros("edge")).withColumn("total", F.ceil(F.greatest(F.col("b") - F.col("a"), F.lit(0)) / width)).withColumn("ahead", F.greatest(F.floor((F.col("b") - F.col("edge")) / width), F.lit(0)))
    d = dirty.select(F.col("id").alias("d_id"), micros("bucket").alias("d")).distinct()
    past = F.col("d") - F.col("edge")
    within = (F.col("d") >= F.col("a")) & (F.col("d") < F.col("b")) & ~((past % width == 0) & (past >= 0) & (past / width < F.col("ahead")))
    again = s.join(d, F.col("id") == F.col("d_id")).where(within).groupBy("id").agg(F.count(F.lit(1)).alias("again"))
    met = s.join(again, "id", "left").withColumn("left", F.col("ahead") + F.coalesce("again", F.lit(0))).withColumn("done", F.greatest(F.col("total") - F.col("ahead"), F.lit(0)))
    percent = F.when(F.col("total") > 0, F.floor(1000 * F.col("done") / F.col("total") + 0.5) / 10).otherwise(100.0)
    eta = F.when(F.col("left") == 0, 0).when(F.col("per_minute") > 0, F.ceil(F.col("left") / F.col("per_minute")))
    return met.select("id", percent.alias("percent"), F.col("done").cast("long").alias("completed"), F.col("total").cast("long").alias("total"), F.col("left").cast("long").alias("remaining"), eta.cast("long").alias("eta_minutes"))


def backlog(jobs: DataFrame) -> DataFrame:
    """Pending and running jobs of each zone, hours and days apart, and the oldest that waits."""
    n = lambda s, u: F.count_if((F.col("state") == s) & (F.col("unit") == u)).alias(f"{s}_{u}s")
    return jobs.groupBy("zone").agg(*[n(s, u) for s in ("pending", "running") for u in ("hour", "day")], F.min(F.when(F.col("state") == "pending", F.col("label"))).alias("oldest"))


@dataclass(frozen=True)
class Cutover:
    state: str = "backfilling"  # then observing, active, fallback
    healthy: int = 0
    failures: int = 0
    checked: datetime | None = None
    validated: datetime | None = None


def observe(c: Cutover, now: datetime, ready: bool) -> tuple[Cutover, bool]:
    """The record after a look at the layer's health, and whether it is to be validated now.

    While active, the third failure in a row takes reads back to raw events; before that failures only wait."""
    if not ready:
        n = c.failures + (c.state == "active")
        return replace(c, state="fallback" if c.state == "active" and n >= FAILURES else c.state, failures=n, checked=now), False
    if c.state in ("backfilling", "fallback"):
        return replace(c, checked=now), True
    if c.state == "observing":
        step = min(STEP, max(0, int((now - c.checked).total_seconds()))) if c.checked else 0
        healthy = min(HEALTHY, c.healthy + step)
        whole = healthy >= HEALTHY
        return replace(c, healthy=healthy, failures=c.failures if whole else 0, checked=now), whole
    due = c.validated is None or (now - c.validated).total_seconds() >= REVALIDATE
    return replace(c, failures=c.failures if due else 0, checked=now), due


def validated(c: Cutover, now: datetime, sound: bool, mismatch: bool = False) -> Cutover:
    """After a validation: on to observing, then to active; a mismatch, or the third failure while active, leads back."""
    if not sound:
        n = c.failures + 1
        back = mismatch or (c.state == "active" and n >= FAILURES)
        return replace(c, state="fallback" if back else c.state, failures=n, checked=now)
    if c.state in ("backfilling", "fallback"):
        return Cutover("observing", 0, 0, now, now)
    return replace(c, state="active", failures=0, checked=now, validated=now)


def watched(looks: Column) -> Column:
    """What becomes of a layer by looks at it (an array of structs in order: at in seconds, ready, sound), from backfilling
    on: `observe`, and `validated` where it is due, as one fold.  A struct of state, healthy, failures, checked, validated."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit("backfilling").alias("state"), F.lit(0).cast("long").alias("healthy"), F.lit(0).cast("long").alias("failures"), none.alias("checked"), none.alias("validated"))

    def after(c: Column, look: Column) -> Column:
        at, active = look["at"].cast("long"), c["state"] == "active"
        new, watching = c["state"].isin("backfilling", "fallback"), c["state"] == "observing"
        passed = F.coalesce(F.least(F.lit(STEP), F.greatest(F.lit(0), at - c["checked"])), F.lit(0)).cast("long")
        healthy = F.when(look["ready"] & watching, F.least(F.lit(HEALTHY), c["healthy"] + passed)).otherwise(c["healthy"]).cast("long")
        due = F.when(new, True).when(watching, healthy >= HEALTHY).otherwise(F.coalesce(at - c["validated"] >= REVALIDATE, F.lit(True)))
        check, ok = look["ready"] & due, look["sound"]
        failed = c["failures"] + F.when(~look["ready"], active.cast("long")).when(check & ~ok, 1).otherwise(0)
        failures = F.when(~look["ready"], failed).when(check & ok, 0).when(check, failed).when(new, c["failures"]).otherwise(0).cast("long")
        back = F.when(~look["ready"], active & (failed >= FAILURES)).when(check & ~ok, active & (failed >= FAILURES)).otherwise(False)
        state = F.when(back, "fallback").when(check & ok, F.when(new, "observing").otherwise("active")).otherwise(c["state"])
        return F.struct(state.alias("state"), F.when(check & ok & new, 0).otherwise(healthy).cast("long").alias("healthy"), failures.alias("failures"), at.alias("checked"), F.when(check & ok, at).otherwise(c["validated"]).alias("validated"))

    return F.aggregate(looks, start, after)


def layer(mode: str, rollup: Cutover, zones: Cutover) -> str:
    """What reads go to: raw, rollup or zones; in mode auto a layer counts only while active, and zones need the rollup."""
    if mode == "raw" or (mode == "auto" and rollup.state != "active"):
        return "raw"
    return "zones" if zones.state == "active" else "rollup"


#: A running job that hasn't been heard of for so many seconds may be claimed again.
ABANDONED = 5 * 60


def with_readiness(jobs: DataFrame, dirty: DataFrame, watermark: datetime) -> DataFrame:
    """Jobs (id, source_from, source_to) with `ready`: all their 15-minute buckets are below the watermark and none is dirty
    (column bucket).  A job is expanded to its buckets, 96 or so a day, so the dirty ones meet them by an equal key."""
    step = F.make_dt_interval(mins=F.lit(15))
    within = jobs.select("id", F.explode(F.sequence("source_from", F.col("source_to") - step, step)).alias("bucket"))
    held = within.join(dirty.select("bucket").distinct(), "bucket", "left_semi").select("id").distinct().withColumn("held", F.lit(True))
    below = F.coalesce(F.col("source_to") <= F.lit(watermark), F.lit(False))
    return jobs.join(held, "id", "left").withColumn("ready", below & F.col("held").isNull()).drop("held")


def _waiting(now: datetime):
    lost = (F.col("state") == "running") & (F.col("updated_at") < F.lit(now - timedelta(seconds=ABANDONED)))
    return (F.col("state") == "pending") | lost


def claimed(jobs: DataFrame, dirty: DataFrame, watermark: datetime, now: datetime, limit: int) -> DataFrame:
    """All jobs after a claim by the one writer: the oldest that wait and are ready are running as of now, `claimed` marks them."""
    oldest = with_readiness(jobs, dirty, watermark).where(F.col("ready") & _waiting(now)).orderBy("created_at", "id").limit(limit)
    met = jobs.join(F.broadcast(oldest.select("id", F.lit(True).alias("claimed"))), "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return met.withColumn("state", F.when(F.col("claimed"), "running").otherwise(F.col("state"))).withColumn("updated_at", F.when(F.col("claimed"), F.lit(now)).otherwise(F.col("updated_at")))


def shared_claims(jobs: DataFrame, now: datetime, workers: int, limit: int, order: str = "created_at") -> DataFrame:
    """Which of several workers that claim at once gets which waiting jobs (id, state, updated_at): the oldest go to the
    first, who passes over none, and each further worker skips what those before it hold.  The ranks are of workers x
    limit rows at most."""
    oldest = jobs.where(_waiting(now)).orderBy(order, "id").limit(workers * limit)
    place = F.row_number().over(Window.orderBy(order, "id")) - 1
    return oldest.withColumn("worker", F.floor(place / limit).cast("int"))


def waiting_counts(jobs: DataFrame, dirty: DataFrame, watermark: datetime, now: datetime) -> DataFrame:
    """How many jobs could be claimed, and how many wait for the buckets below them."""
    w = with_readiness(jobs, dirty, watermark).where(_waiting(now))
    return w.agg(F.count_if("ready").alias("eligible"), F.count_if(~F.col("ready")).alias("waiting"))


def completed(jobs: DataFrame, results: DataFrame, dirty: DataFrame, watermark: datetime, now: datetime) -> DataFrame:
    """All jobs after results (id, generation, ok): a running job of that generation is done if it is still ready, and
    pending again if it failed; a job that was invalidated meanwhile, or isn't ready any more, stays as it is."""
    r = results.select("id", F.col("generation").alias("r_generation"), "ok")
    met = with_readiness(jobs, dirty, watermark).join(r, "id", "left")
    mine = (F.col("state") == "running") & (F.col("generation") == F.col("r_generation"))
    state = F.when(mine & F.col("ok") & F.col("ready"), "done").when(mine & ~F.col("ok"), "pending").otherwise(F.col("state"))
    moved = F.coalesce(mine & ((F.col("ok") & F.col("ready")) | ~F.col("ok")), F.lit(False))
    return met.withColumn("updated_at", F.when(moved, F.lit(now)).otherwise(F.col("updated_at"))).withColumn("state", state).select(*jobs.columns)


def first_tasks(candidates: DataFrame, now: datetime, by: str) -> DataFrame:
    """`next_task` of every coordinator at once: candidates (by, task, due, next_attempt, last_started, eligible_since)."""
    since = lambda c: F.unix_micros(F.lit(now)) - F.unix_micros(c)
    wait = F.when(F.col("task") == "pricing_repair", REPAIR_CADENCE).otherwise(CADENCE) * 1_000_000
    rested = F.col("last_started").isNull() | (since("last_started") >= wait)
    ready = F.col("due") & rested & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= F.lit(now)))
    starved = F.coalesce(since("eligible_since") >= STARVED * 1_000_000, F.lit(False))
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("task"))
    urgency = F.struct((F.col("task") != "validation").alias("a"), (~starved).alias("b"), F.coalesce(F.unix_micros("last_started"), F.lit(-(1 << 62))).alias("c"), place.alias("d"))
    return candidates.where(ready).groupBy(by).agg(F.min_by("task", urgency).alias("task"))


def limit_after(limit: Column, processed: Column, duration_ms: Column, failed: Column, least: int, most: int) -> Column:
    """`next_limit` as an expression."""
    at = F.least(F.lit(most), F.greatest(F.lit(least), limit))
    less = F.greatest(F.lit(least), F.floor(at / 2))
    more = F.least(F.lit(most), F.ceil(at * 1.25))
    return F.when(failed | (duration_ms >= SLOW_MS), less).when((processed >= at) & (duration_ms <= FAST_MS), more).otherwise(at).cast("int")


def read_layer(mode: Column, rollup: Column, zones: Column) -> Column:
    """`layer` as an expression over the layers' states."""
    raw = (mode == "raw") | ((mode == "auto") & (rollup != "active"))
    return F.when(raw, "raw").when(zones == "active", "zones").otherwise("rollup")
