"""One object for what callers ask of the engine: save, repair, and the dashboards' questions, over Parquet tables below a root.

Facts are append-only.  `usage_events` has the first row of every key; a row that is repriced, moved to a team or withdrawn
is in `replacements` under a higher version.  Reads take the last version of replaced keys and all others as they are, so a
scan without replacements needs no shuffle, and one with few needs a broadcast at most.  Both tables are partitioned by
the month of `ts` (in UTC), so a question about a period reads its months alone; a key always has the same `ts`.  One
writer at a time.

Marks, replacements and rollups are kept in segments under one manifest (plans/snapshots.py): what belongs together appears
at once, and what is superseded goes as segments are merged, so reads cost what is live.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import replace
from datetime import UTC, datetime, timedelta
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .functions import cursor, timeutil
from .operators import compare, history, ingest, pricing, repair, tools, usage
from .operators.usage import Scope
from .plans import distinct, jobs, outbox, rollup
from .plans.snapshots import GRACE, Snapshots

EVENT = """event_id bigint, dedup_key string, provider_key string, user_id bigint, session_id string, model string, host string,
ts timestamp, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint,
cost_usd decimal(18,8), cost_status string, event_count bigint, team_id bigint, revision_id int"""

#: Columns by which the files of tables in segments are parted.
PARTED = {"dirty": (), "compacted": (), "replacements": ("event_month",), "quarter_hours": ("event_month",), "zone_days": ("zone", "day_month"), "zone_notes": (), "turn_trigrams": (), "numbers": ("of",), "zone_sums": ("zone", "day_month"), "zone_sets": ("zone", "day_month")}


def _last_compactions(done: DataFrame) -> DataFrame:
    return done.groupBy(F.col("bucket").alias("ts")).agg(F.max("mark").alias("version"))


def _last_notes(notes: DataFrame) -> DataFrame:
    return notes.groupBy("zone", "day").agg(F.max("version").alias("version"), F.max_by("upto", "version").alias("upto"))


def _pending(dirty: DataFrame, done: DataFrame | None) -> DataFrame:
    """Buckets (bucket, mark) that changed and weren't compacted since."""
    last = dirty.groupBy("bucket").agg(F.max("mark").alias("mark"))
    if done is None:
        return last
    met = last.join(done.groupBy("bucket").agg(F.max("mark").alias("done")), "bucket", "left")
    return met.where(F.col("done").isNull() | (F.col("done") <= F.col("mark"))).select("bucket", "mark")


def _of_last_notes(rows: DataFrame, read) -> DataFrame:
    return rows.join(_last_notes(read("zone_notes")), ["zone", "day", "version"], "left_semi").select(*rows.columns)


#: What is live of each table's rows.
REDUCED = {
    "dirty": lambda rows, read: _pending(rows, read("compacted")),
    "compacted": lambda rows, read: rows.groupBy("bucket").agg(F.max("mark").alias("mark")),
    "replacements": lambda rows, read: ingest.latest(rows).select(*rows.columns),
    "quarter_hours": lambda rows, read: rows.join(_last_compactions(read("compacted")), ["ts", "version"], "left_semi").select(*rows.columns),
    "turn_trigrams": lambda rows, read: rows.groupBy("block", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")),
    "zone_notes": lambda rows, read: _last_notes(rows),
    "zone_days": _of_last_notes,
    "zone_sums": _of_last_notes,
    "zone_sets": _of_last_notes,
    "numbers": lambda rows, read: rows,
}


#: Sessions of a block of history, as a power of two.
BLOCK_BITS = 12


class Found(NamedTuple):
    """One answer of a search: its turns, where to go on (None: all is searched), blocks that were read and passed over."""

    turns: DataFrame
    after: str | None
    read: int
    passed: int


class UsageStore:
    def __init__(self, spark: SparkSession, root: str, revisions: DataFrame, assignments: DataFrame, users: DataFrame, teams: DataFrame, zone: str = "UTC", capable: tuple[str, ...] = ()):
        self.spark, self.root, self.zone, self.capable = spark, root.rstrip("/"), zone, list(capable)
        self.revisions, self.assignments, self.users, self.teams = revisions, assignments, users, teams
        self.columns = spark.createDataFrame([], EVENT).columns
        self.snapshots = Snapshots(spark, self.root, REDUCED)
        self.layers = None

    def serve_from(self, maintenance) -> None:
        """From now on questions read what its source() gives: rollups where they are complete, raw events elsewhere."""
        self.layers = maintenance

    # Tables

    def table(self, name: str) -> DataFrame | None:
        if name in PARTED:
            return self.snapshots.read(name)
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _segments(self, **rows: DataFrame) -> None:
        """New rows of tables in segments, which appear together."""
        self.snapshots.append(*[(name, df, PARTED[name]) for name, df in rows.items()])

    def _append(self, df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("append").partitionBy(*by).parquet(f"{self.root}/{name}")

    def _staged(self, df: DataFrame) -> DataFrame:
        """Written before it is used more than once, so that all uses see the same rows."""
        fs, root = self.snapshots.files.fs, self.snapshots.files.path(f"{self.root}/staging")
        for old in fs.listStatus(root) if fs.exists(root) else []:
            if time.time() - old.getModificationTime() / 1000 > 24 * GRACE:  # of jobs that have long ended
                fs.delete(old.getPath(), True)
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _months(self, name: str, period: tuple[str | datetime, str | datetime] | None) -> DataFrame | None:
        """A table of facts, of a period (its end included) only the months."""
        rows = self.table(name)
        if rows is None or period is None:
            return rows
        first, last = (X.utc_month(F.lit(x).cast("timestamp")) for x in period)
        return rows.where((F.col("event_month") >= first) & (F.col("event_month") <= last))

    def events(self, period: tuple[str | datetime, str | datetime] | None = None) -> DataFrame:
        """All events, or those of the months of a period."""
        base, again = self._months("usage_events", period), self._months("replacements", period)
        if base is None:
            return self.spark.createDataFrame([], EVENT)
        if again is None:
            return base.select(*self.columns)
        last = ingest.latest(again)
        kept = base.join(last.select("dedup_key"), "dedup_key", "left_anti")
        return kept.select(*self.columns).unionByName(last.where("NOT gone").select(*self.columns))

    def _replace(self, rows: DataFrame, gone: bool = False) -> None:
        version = F.lit(time.time_ns()).cast("long")
        again = rows.select(*self.columns, version.alias("version"), F.lit(gone).alias("gone"), X.utc_month(F.col("ts")).alias("event_month"))
        self._segments(replacements=again, dirty=self._marks(rows))

    def _marks(self, rows: DataFrame) -> DataFrame:
        """The buckets of changed rows are dirty until they are compacted after this."""
        return ingest.dirty_buckets(rows).withColumn("mark", F.lit(time.time_ns()))

    def _scan(self, scope: Scope) -> DataFrame:
        return usage.scan(self.events((scope.start, scope.end)), scope)

    def _measured(self, scope: Scope, zone: str | None = None) -> DataFrame:
        """Rows for measures by dimensions of the rollup, and by local days of a zone (without one: by any bucket)."""
        if self.layers is None or scope.team is not None:
            return self._scan(scope)
        start, end = (t if t.tzinfo else t.replace(tzinfo=UTC) for t in map(datetime.fromisoformat, (scope.start, scope.end)))
        return usage.scan(self.layers.source(start, end, zone=zone), scope)

    def _oldest(self, rows: DataFrame, limit: int) -> tuple[DataFrame, bool]:
        """The oldest rows up to a limit, and whether there are more."""
        batch = self._staged(rows.orderBy("ts", "dedup_key").limit(limit + 1))
        more = batch.count() > limit
        return (batch.orderBy("ts", "dedup_key").limit(limit) if more else batch), more

    # Writes and repair

    def save_raw_events(self, payloads: DataFrame) -> None:
        """payloads: provider_key, payload, received_at."""
        self._append(payloads.withColumn("received_day", F.to_date("received_at")), "raw_events", "received_day")

    def save_usage_events(self, batch: DataFrame) -> dict[str, int]:
        """Priced by time, attributed to the team of that time; a key that is there already is passed over.  A batch that
        is sent again inserts nothing, and a withdrawn key may come back.  Only the months of the batch are read."""
        price = pricing.priced(batch.drop("team_id", "revision_id"), self.revisions)
        rows = price.withColumns({"cost_usd": F.col("price").cast("decimal(18,8)"), "cost_status": F.col("status")})
        rows = self._staged(ingest.attributed(rows.drop("price", "status"), self.assignments).select(*self.columns))
        *period, sent = rows.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
        if not sent:
            return {"inserted": 0, "deduped": 0}
        new = self._staged(ingest.new_rows(rows, self.events(period), order="ts"))
        base = self._months("usage_events", period)
        if base is not None:
            back = new.join(base.select("dedup_key"), "dedup_key", "left_semi")
            if not back.isEmpty():
                self._replace(back)
                new_keys = new.join(base.select("dedup_key"), "dedup_key", "left_anti")
                inserted, new = new.count(), self._staged(new_keys)
            else:
                inserted = new.count()
        else:
            inserted = new.count()
        self._segments(dirty=self._marks(new))  # first: a mark without its events does no harm
        self._append(new.withColumn("event_month", X.utc_month(F.col("ts"))), "usage_events", "event_month")
        return {"inserted": inserted, "deduped": sent - inserted}

    def recompute_daily(self, days: list[str]) -> None:
        """Rebuilds these local days of both marts and no others."""
        if not days:
            return
        near = (datetime.fromisoformat(min(days)) - timedelta(days=2), datetime.fromisoformat(max(days)) + timedelta(days=3))
        rows = self.events(near).where(X.bucket_label("ts", self.zone).isin(*days))
        for key, name in (("user_id", "user_days"), ("team_id", "team_days")):
            ingest.rewrite_days(self.spark, ingest.daily_mart(rows, self.zone, key), f"{self.root}/{name}")

    def preview_unassigned(self, scope: Scope) -> DataFrame:
        return ingest.unattributed(self._scan(scope))

    def backfill_unassigned(self, user: int, team: int, start: str, end: str, limit: int = 1000) -> dict:
        """Gives the oldest of a user's events without a team one."""
        rows, more = self._oldest(self._scan(Scope(start, end, user=user)).where("team_id IS NULL"), limit)
        filled = repair.team_backfill(rows, user, team, start, end).where("filled")
        n = filled.count()
        if n:
            self._replace(filled)
        return {"processed": n, "updated": n, "affected_buckets": ingest.dirty_buckets(filled), "has_more": more}

    def pricing_recovery_models(self, start: str, end: str) -> DataFrame:
        return ingest.diagnostics(self._scan(Scope(start, end)))

    def repair_pricing(self, start: str, end: str, limit: int = 500, weak: DataFrame | None = None) -> dict:
        """Prices the oldest events that have no sound price, or one by a revision found not authoritative (weak:
        revision_id), and for which there is one now."""
        sound = self.revisions if weak is None else self.revisions.join(weak.select(F.col("revision_id").alias("id")), "id", "left_anti").select(*self.revisions.columns)
        known = pricing.segments(sound)
        candidates = repair.price_candidates(self._scan(Scope(start, end)), weak)
        on = (F.col("model") == F.col("model_id")) & (F.col("s_from") <= F.col("ts")) & (F.col("s_until").isNull() | (F.col("ts") < F.col("s_until")))
        rows, more = self._oldest(candidates.join(known, on, "left_semi"), limit)
        out = repair.price_repair(rows, sound, weak).where(F.col("outcome").isin("recovered", "repriced"))
        out = self._staged(out.withColumns({"cost_usd": F.col("price").cast("decimal(18,8)"), "cost_status": F.lit("priced")}).select(*self.columns, "outcome"))
        n = {r[0]: r[1] for r in out.groupBy("outcome").count().collect()}
        if n:
            self._replace(out)
        return {"scanned": rows.count(), "recovered": n.get("recovered", 0), "repriced": n.get("repriced", 0), "affected_buckets": ingest.dirty_buckets(out), "has_more": more}

    def reconcile_replays(self, start: str, end: str, limit: int = 1000) -> dict:
        """Withdraws unpriced events without a model that have an exact twin with one."""
        rows, more = self._oldest(ingest.replayed(self._scan(Scope(start, end))), limit)
        n = rows.count()
        if n:
            self._replace(rows, gone=True)
        return {"reconciled": n, "affected_buckets": ingest.dirty_buckets(rows), "has_more": more}

    def reconcile_usage(self, user: int, provider: str, keys: DataFrame, period: tuple[str, str] | None = None) -> dict:
        """Withdraws listed keys (dedup_key) of one user and provider; keys of others stay.  Of a period only its months
        are read."""
        mine = self.events(period).where((F.col("user_id") == user) & (F.col("provider_key") == provider))
        rows = self._staged(mine.join(keys.select("dedup_key").distinct(), "dedup_key", "left_semi").select(*self.columns))
        n = rows.count()
        if n:
            self._replace(rows, gone=True)
        return {"reconciled": n, "affected_buckets": ingest.dirty_buckets(rows)}

    def pending_buckets(self) -> DataFrame:
        """Buckets that changed and weren't compacted since."""
        state = self.snapshots.load()
        dirty = self.snapshots.read("dirty", state)
        if dirty is None:
            return self.spark.createDataFrame([], "bucket timestamp")
        return _pending(dirty, self.snapshots.read("compacted", state)).select("bucket")

    def compact_buckets(self, buckets: list[datetime]) -> None:
        """15-minute rows of these buckets, a bounded list, which replace the buckets' old rows when read."""
        if not buckets:
            return
        width = F.expr("interval 15 minutes")
        rows = self.events((min(buckets), max(buckets) + timedelta(minutes=15))).where((F.col("ts") >= F.lit(min(buckets))) & (F.col("ts") < F.lit(max(buckets)) + width))
        self._compact(rows.where(X.bucket_start("ts").isin(*[F.lit(b) for b in buckets])), self.spark.createDataFrame([(b,) for b in buckets], "bucket timestamp"))

    def compact(self, start: str, end: str) -> None:
        """15-minute rows of all changed buckets of a range that begins and ends on bucket edges."""
        at = lambda x: F.lit(x).cast("timestamp")
        buckets = self._staged(self.pending_buckets().where((F.col("bucket") >= at(start)) & (F.col("bucket") < at(end))))
        rows = self._scan(Scope(start, end)).withColumn("bucket", X.bucket_start("ts")).join(buckets, "bucket", "left_semi")
        self._compact(rows, buckets)

    def _compact(self, rows: DataFrame, buckets: DataFrame) -> None:
        """Rows and the note of their version, which appear together."""
        version = time.time_ns()
        made = rollup.compact(rows, version).withColumn("event_month", X.utc_month(F.col("ts")))
        self._segments(quarter_hours=made, compacted=buckets.select("bucket", F.lit(version).alias("mark")))

    def quarter_hours(self, period: tuple[str | datetime, str | datetime] | None = None) -> DataFrame:
        """Of each bucket the rows of its last compaction, none if that found no events; of a period only its buckets'."""
        state = self.snapshots.load()
        rows, done = self.snapshots.read("quarter_hours", state), self.snapshots.read("compacted", state)
        if rows is None or done is None:
            return rollup.compact(self.events().where("false"))
        if period:
            first, last = (F.lit(x).cast("timestamp") for x in period)
            done = done.where((F.col("bucket") >= X.bucket_start(first)) & (F.col("bucket") <= last))
            rows = rows.where((F.col("event_month") >= X.utc_month(first)) & (F.col("event_month") <= X.utc_month(last)) & (F.col("ts") >= X.bucket_start(first)) & (F.col("ts") <= last))
        return rows.join(_last_compactions(done), ["ts", "version"], "left_semi").select(*[c for c in rows.columns if c != "event_month"])

    def newest_compaction(self) -> int:
        done = self.table("compacted")
        return 0 if done is None else done.agg(F.coalesce(F.max("mark"), F.lit(0))).first()[0]

    def compacted_between(self, after: int, to: int) -> DataFrame:
        """Buckets that were compacted last after one mark and up to another."""
        return self.table("compacted").groupBy("bucket").agg(F.max("mark").alias("mark")).where((F.col("mark") > after) & (F.col("mark") <= to)).select("bucket")

    def roll_zones(self, zones: list[str], after: int, to: int) -> None:
        """Rebuilds the local days of these zones that were changed by compactions after one and up to another, and no
        others: of all zones in one pass over the rows of these days."""
        changed = self._staged(self.compacted_between(after, to))
        first, last = changed.agg(F.min("bucket") - F.expr("interval 2 days"), F.max("bucket") + F.expr("interval 2 days")).first()
        if first is None:
            return
        days = self._staged(jobs.affected_jobs(changed, zones).where("unit = 'day'").select("zone", F.col("label").alias("day")))
        label = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), X.bucket_label("ts", z).alias("day")) for z in zones])).alias("local")
        rows = self.quarter_hours((first, last)).select("*", label).select("*", "local.*").drop("local").join(days, ["zone", "day"], "left_semi")
        version, month = time.time_ns(), F.substring("day", 1, 7).alias("day_month")
        noted = lambda df: df.select("*", F.lit(version).alias("version"), month)
        known, cell = self.snapshots.read("numbers"), {"zone": "zone", "day": "day", "provider_key": "provider_key"}
        new = self._staged(distinct.numbered(rows, known))
        sets = distinct.sets(rows, new if known is None else known.unionByName(new), **cell)
        self._segments(numbers=new, zone_days=noted(rollup.daily(rows, "zone", "day")), zone_sums=noted(distinct.totals(rows, **cell)), zone_sets=noted(sets), zone_notes=days.select("zone", "day", F.lit(version).alias("version"), F.lit(to).alias("upto")))

    def zone_days(self, zone: str, period: tuple[str, str] | None = None) -> DataFrame | None:
        """The rows of a zone's local days as they were rolled up last; of a period (two days, both included) only these."""
        return self._of_zone("zone_days", zone, period, self.snapshots.load())

    def _of_zone(self, name: str, zone: str, period: tuple[str, str] | None, state: dict) -> DataFrame | None:
        rows, notes = self.snapshots.read(name, state), self.snapshots.read("zone_notes", state)
        if rows is None or notes is None:
            return None
        rows, notes = (x.where(F.col("zone") == zone) for x in (rows, notes))
        if period:
            rows = rows.where(F.col("day_month").between(period[0][:7], period[1][:7]) & F.col("day").between(*period))
            notes = notes.where(F.col("day").between(*period))
        last = _last_notes(notes).select("day", "version")
        return rows.join(last, ["day", "version"], "left_semi").select(*[c for c in rows.columns if c not in ("version", "day_month")])

    def ready_days(self, zone: str, start: datetime, end: datetime) -> frozenset[str]:
        """The zone's local days of a period that were rolled up after the last compaction of any of their buckets."""
        state = self.snapshots.load()
        notes, done = self.snapshots.read("zone_notes", state), self.snapshots.read("compacted", state)
        if notes is None or done is None:
            return frozenset()
        near = done.where((F.col("bucket") >= F.lit(start) - F.expr("interval 1 day")) & (F.col("bucket") < F.lit(end) + F.expr("interval 1 day")))
        marks = near.groupBy(X.bucket_label("bucket", zone).alias("day")).agg(F.max("mark").alias("mark"))
        rows = _last_notes(notes.where(F.col("zone") == zone)).join(marks, "day").where("mark <= upto").select("day").collect()  # a row a day
        return frozenset(r[0] for r in rows)

    def reconcile_rollups(self, start: str, end: str) -> DataFrame:
        """Buckets whose rollup has all events but other statuses or costs."""
        period, none = Scope(start, end), self.spark.createDataFrame([], "bucket timestamp")
        return repair.stale_buckets(self._scan(period), usage.scan(self.quarter_hours((start, end)), period), none)

    # Questions

    def _by_sets(self, scope: Scope, zone: str, *by: str) -> DataFrame | None:
        """The measures by `day` of the zone, `provider_key`, both or none: from sums and sets of the local days that are
        rolled up, and from other layers for the rest.  None if no day is, or the scope needs what a set doesn't tell."""
        if self.layers is None or (scope.user, scope.team, scope.users) != (None, None, None):
            return None
        start, end = (t if t.tzinfo else t.replace(tzinfo=UTC) for t in map(datetime.fromisoformat, (scope.start, scope.end)))
        p, state = self.layers.plan(start, end, zone=zone), self.snapshots.load()
        if not p.days or not all(state.get(name) for name in ("numbers", "zone_sums", "zone_sets")):
            return None
        numbers, period = self.snapshots.read("numbers", state), (p.days[0][0], p.days[-1][1])
        taken = reduce(or_, [F.col("day").between(a, b) for a, b in p.days])
        if scope.provider is not None:
            taken &= F.col("provider_key") == scope.provider
        days, sets = (self._of_zone(name, zone, period, state).where(taken).drop("zone") for name in ("zone_sums", "zone_sets"))
        key = {"day": X.bucket_label("ts", zone), "provider_key": "provider_key"}
        if p.raw or p.rollup:
            rest = usage.scan(self.layers.read(replace(p, days=()), start), scope)
            days, sets = days.unionByName(distinct.totals(rest, **key)), sets.unionByName(distinct.sets(rest, numbers, **key))
            beside = distinct.unnumbered(rest, numbers, **{k: key[k] for k in by})
        else:
            beside = None
        return distinct.measured(days, sets, beside, **{k: k for k in by})

    def overview(self, scope: Scope) -> DataFrame:
        found = self._by_sets(scope, self.zone)
        return usage.overview(self._measured(scope, self.zone)) if found is None else found

    def daily_series(self, scope: Scope, bucket: str = "day", zone: str | None = None) -> DataFrame:
        zone = zone or self.zone
        found = self._by_sets(scope, zone, "day") if bucket == "day" else None
        if found is not None:
            return found.withColumnRenamed("day", "bucket").drop(*distinct.EVENTS)
        return usage.series(self._measured(scope, zone if bucket == "day" else None), zone, bucket)

    def member_series(self, scope: Scope, bucket: str = "day", zone: str | None = None) -> DataFrame:
        zone = zone or self.zone
        return usage.series(self._measured(scope, zone if bucket == "day" else None), zone, bucket, "user_id")

    def user_usage(self, scope: Scope, bucket: str = "day") -> dict[str, DataFrame]:
        rows = self._measured(scope, self.zone if bucket == "day" else None)
        return {"overview": usage.overview(rows), "daily": usage.series(rows, self.zone, bucket), "by_model": usage.breakdown(rows, "model", "(unknown)"), "by_host": usage.breakdown(rows, "host")}

    def insight_comparison(self, current: Scope, previous: Scope, zone: str | None = None) -> dict[str, DataFrame]:
        both = compare.tagged(self.events((min(current.start, previous.start), max(current.end, previous.end))), current, previous)
        return {"trend": compare.summary_and_trend(both, zone or self.zone, current.start, previous.start), "composition": compare.composition(both)}

    def utilization_usage(self, scope: Scope, zone: str | None = None) -> DataFrame:
        return tools.usage_days(self._scan(scope), zone or self.zone, self.capable)

    def organization_dashboard(self, current: Scope, previous: Scope, with_teams: bool = True, order: str = "cost") -> dict[str, DataFrame]:
        now = self._measured(current, self.zone)
        out = {"current": usage.overview(now), "previous": self.overview(previous), "daily": usage.series(now, self.zone), "providers": usage.breakdown(now, "provider_key"), "users": usage.leaderboard(now, self.users, "user_id", order)}
        return out | ({"teams": usage.leaderboard(self._scan(current), self.teams, "team_id", order)} if with_teams else {})

    def model_series(self, scope: Scope, bucket: str = "day") -> DataFrame:
        return usage.bucket_by(self._measured(scope, self.zone if bucket == "day" else None), self.zone, bucket, "model", "(unknown)")

    def hourly_series(self, scope: Scope, zone: str | None = None) -> DataFrame:
        return self.daily_series(scope, "hour", zone)

    def leaderboard(self, scope: Scope, by: str = "user", order: str = "cost") -> DataFrame:
        rows = self._measured(scope, self.zone) if by == "user" else self._scan(scope)
        return usage.leaderboard(rows, self.users if by == "user" else self.teams, f"{by}_id", order)

    def provider_breakdown(self, scope: Scope) -> DataFrame:
        found = self._by_sets(scope, self.zone, "provider_key")
        return usage.breakdown(self._measured(scope, self.zone), "provider_key") if found is None else found

    def user_hosts(self, user: int, period: tuple[str, str] | None = None) -> DataFrame:
        return usage.devices(self.events(period).where(F.col("user_id") == user))

    def session_summaries(self, user: int, sessions: DataFrame, period: tuple[str, str] | None = None) -> DataFrame:
        mine = self.events(period).where(F.col("user_id") == user)
        return usage.session_summaries(mine.join(sessions.select("session_id").distinct(), "session_id", "left_semi"))

    def session_events(self, user: int, session: str) -> DataFrame:
        return self.events().where((F.col("user_id") == user) & (F.col("session_id") == session)).orderBy("ts", "dedup_key")

    def storage_stats(self) -> DataFrame:
        """Rows, first and last instant of each table of facts (the mart's days aside)."""
        out = None
        for name in ("raw_events", "usage_events", "replacements", "quarter_hours"):
            rows = self.table(name)
            at = "received_at" if name == "raw_events" else "ts"
            one = (self.spark.createDataFrame([(0, None, None)], "n long, first timestamp, last timestamp") if rows is None else rows.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))).select(F.lit(name).alias("name"), "n", "first", "last")
            out = one if out is None else out.unionByName(one)
        return out

    def supports_zone(self, zone: str) -> bool:
        return zone in timeutil.available_timezones()

    def flush_outbox(self, batches: DataFrame, now: datetime, send, limit: int = 100) -> DataFrame:
        """batches (batch_id, state, updated_at): claims the waiting ones, sends each by a call that may fail, and gives all
        of them as they are then.  A batch that failed is pending again."""
        held = self._staged(outbox.claimed(batches, now, limit))
        done = []
        for (batch_id,) in held.where("claimed").select("batch_id").orderBy("batch_id").collect():  # limit at most
            try:
                send(batch_id)
                done.append((batch_id, True))
            except Exception:  # whatever the receiver raised
                done.append((batch_id, False))
        return outbox.delivered(held.drop("claimed"), self.spark.createDataFrame(done, f"batch_id {dict(batches.dtypes)['batch_id']}, ok boolean"))

    # History (turns: user_id, session, turn, role, text) and tools

    def save_turns(self, turns: DataFrame) -> None:
        """Turns lie in blocks of sessions, each with bitmaps of its texts' trigrams beside it (first, so that no turn is
        without).  Everything below reads the turns of one user alone."""
        rows = self._staged(turns.select("user_id", "session", "turn", "role", "text").withColumn("block", F.shiftright("session", BLOCK_BITS)))
        self._segments(turn_trigrams=history.trigram_bits(rows, "block"))
        self._append(rows, "turns", "block")

    def _turns(self, user: int) -> DataFrame:
        rows = self.table("turns")
        if rows is None:
            return self.spark.createDataFrame([], "session bigint, turn bigint, role string, text string, block bigint")
        return rows.where(F.col("user_id") == user).dropDuplicates(["session", "turn"]).select("session", "turn", "role", "text", F.col("block").cast("long").alias("block"))

    def history_page(self, user: int, before: tuple[int, int] | None = None, size: int = 20) -> tuple[DataFrame, bool]:
        """Sessions, the last active first, with a preview of their request, and whether there are more."""
        rows = self._staged(history.page(history.groups(self._turns(user), requests=True), before, size))
        return rows.orderBy(F.desc("last_turn"), F.desc("session")).limit(size), rows.count() > size

    def history_search(self, user: int, words: str, secret: str, after: str | None = None, size: int = 20, blocks: int = 64) -> Found:
        """Turns of a user that hold the words, the last sessions first, up to a size, from at most so many blocks of
        sessions; the search goes on where the cursor of an answer points, until an answer has none.  Blocks whose bitmaps
        lack a part of the words aren't read.  ValueError for a cursor of another search."""
        scope = f"user:{user}:{words.lower()}"
        place = cursor.decode_place(after, scope, secret) if after else (1 << 62, 0)
        if place is None:
            raise ValueError("not a cursor of this search")
        index = self.table("turn_trigrams")
        rows = self._turns(user)
        if index is None:
            return Found(rows.select("session", "turn", "role", F.col("text").alias("snippet")), None, 0, 0)
        index = index.where(F.col("block") <= place[0] >> BLOCK_BITS)
        asked = [r[0] for r in history.may_hold(index, words, "block").orderBy(F.desc("block")).limit(blocks + 1).collect()]
        more, asked = len(asked) > blocks, asked[:blocks]
        low = min(asked) if more else -(1 << 62)
        passed = index.where(F.col("block") >= low).select("block").distinct().count() - len(asked)
        before = (F.col("session") < place[0]) | ((F.col("session") == place[0]) & (F.col("turn") < place[1]))
        found = history.hits(rows.where(F.col("block").isin(asked) & before), words).orderBy(F.desc("session"), F.desc("turn")).limit(size + 1)
        found = self._staged(found).orderBy(F.desc("session"), F.desc("turn"))
        ends = found.collect()  # size + 1 at most
        if len(ends) > size:
            on = (ends[size - 1].session, ends[size - 1].turn)
        else:
            on = (low << BLOCK_BITS, 0) if more else None
        return Found(found.limit(size), cursor.encode_place(on, scope, secret) if on else None, len(asked), passed)

    def history_session(self, user: int, session: int) -> DataFrame:
        """The turns of a session in order; those that a tool put there are marked, with the command that they call."""
        mine, said = self._turns(user).where((F.col("block") == session >> BLOCK_BITS) & (F.col("session") == session)), F.col("role") == "user"
        return mine.select("turn", "role", "text", (said & X.is_meta(F.col("text"))).alias("meta"), F.when(said, X.meta_command(F.col("text"))).alias("command")).orderBy("turn")

    def save_tool_events(self, rows: DataFrame) -> None:
        """event_id, user_id, session_id, host, ts, activity_kind, item_key, outcome; a known event_id is passed over."""
        rows = self._staged(rows.dropDuplicates(["event_id"]))
        had = self._months("tool_events", rows.agg(F.min("ts"), F.max("ts")).first())  # of the batch's months
        new = self._staged(rows if had is None else rows.join(had.select("event_id"), "event_id", "left_anti"))
        self._append(new.withColumn("event_month", X.utc_month(F.col("ts"))), "tool_events", "event_month")

    def tool_activity(self, start: str, end: str, user: int | None = None) -> dict[str, DataFrame]:
        """The summary and the table of tools of a period, of one user or of all."""
        rows = self._months("tool_events", (start, end))
        if rows is None:
            rows = self.spark.createDataFrame([], "event_id bigint, user_id bigint, session_id string, host string, ts timestamp, activity_kind string, item_key string, outcome string")
        rows = rows.where(Scope(start, end, user=user).predicate())
        return {"summary": tools.summary(rows), "tools": tools.table(rows), "days": tools.reliability_days(rows, self.zone)}
