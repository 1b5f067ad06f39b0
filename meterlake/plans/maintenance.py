"""The loop that keeps rollups and prices of a store up to date.  Its state is a small numbered file below the store's root,
written beside and then renamed, so that a driver that is lost goes on from the last whole one.  One writer at a time."""

from __future__ import annotations

import time
from dataclasses import asdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..store import UsageStore
from . import jobs, layers, rollup
from .snapshots import NumberedFiles

LEAST, MOST = 25, 500
#: Plans of questions that are kept while the store stays as it is.
PLANS = 256


class Maintenance:
    """tick() runs the task whose turn it is: validation, repair of prices, 15-minute rows (dirty buckets for half a batch at
    most, then on from the watermark), or the local days of zones that these changed."""

    def __init__(self, store: UsageStore, start: datetime, batch: int = 16, zones: tuple[str, ...] = ()):
        self.store, self.start, self.batch, self.names, self.files = store, start, batch, zones, NumberedFiles(store.spark, f"{store.root}/state")
        s = self.files.load()
        at = lambda x: datetime.fromisoformat(x) if x else None
        c = s.get("cutover", {})
        self.watermark = at(s.get("watermark")) or start
        self.cutover = jobs.Cutover(**(c | {k: at(c.get(k)) for k in ("checked", "validated")})) if c else jobs.Cutover()
        self.limit, self.started = s.get("limit", MOST), {k: at(v) for k, v in s.get("started", {}).items()}
        self.check, self.rolled = s.get("check", False), s.get("rolled", {})  # the newest compaction that is in each zone's days
        self.agreed, self.repaired = s.get("agreed", 0), s.get("repaired")  # up to which compaction rows were validated; what was priced
        self.planned: tuple[list, dict] = [], {}

    def _save(self) -> None:
        self.files.save({"watermark": self.watermark, "cutover": asdict(self.cutover), "limit": self.limit, "started": self.started, "check": self.check, "rolled": self.rolled, "agreed": self.agreed, "repaired": self.repaired})

    def dirty(self, most: int) -> list[datetime]:
        """The oldest dirty buckets below the watermark, a bounded number."""
        pending = self.store.pending_buckets().where((F.col("bucket") >= F.lit(self.start)) & (F.col("bucket") < F.lit(self.watermark)))
        rows = pending.orderBy("bucket").limit(most).select(F.unix_seconds("bucket")).collect()
        return [datetime.fromtimestamp(r[0], self.start.tzinfo) for r in rows]

    def tick(self, now: datetime) -> str | None:
        caught_up = self.watermark + rollup.WIDTH > now - timedelta(minutes=30)
        dirty = self.dirty(self.batch)
        if caught_up and not dirty and not self.check:
            self.cutover, self.check = jobs.observe(self.cutover, now, True)
        elif dirty and self.cutover.state == "active":
            self.cutover, _ = jobs.observe(self.cutover, now, False)
        tasks = {"validation": self.check, "pricing_repair": self.repaired != self.priced_by(), "quarter_hours": bool(dirty) or not caught_up}
        if self.names:
            newest = self.store.newest_compaction()
            tasks["zones"] = any(newest > self.rolled.get(z, 0) for z in self.names)
        task = jobs.next_task([jobs.Candidate(t, due, None, self.started.get(t)) for t, due in tasks.items()], now)
        if task:
            self.started[task] = now
            getattr(self, task)(now, dirty)
        self._save()
        return task

    def priced_by(self) -> list:
        """Changes whenever there are new events or other prices: repair has nothing to do before."""
        r = self.store.revisions
        prices = r.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in r.columns]))).first()
        return [self.store.snapshots.load().get("writes", {}).get("dirty", 0), *prices]

    def validation(self, now: datetime, dirty: list[datetime]) -> None:
        """Raw events and 15-minute rows up to the frontier must agree in sums and hash, for all buckets that were compacted
        since they last agreed."""
        end, newest = rollup.frontier(self.watermark, dirty), self.store.newest_compaction()
        changed = self.store.compacted_between(self.agreed, newest) if newest else self.store.pending_buckets().where("false")
        changed = self.store._staged(changed.where((F.col("bucket") >= F.lit(self.start)) & (F.col("bucket") < F.lit(end))))
        first, last = changed.agg(F.min("bucket"), F.max("bucket") + F.expr("interval 15 minutes")).first()
        period = (first or self.start, last or self.start)
        mine = lambda df: df.join(changed, X.bucket_start("ts") == F.col("bucket"), "left_semi")
        a, b = (rollup.fingerprint(mine(x)).first() for x in (self.store.events(period), self.store.quarter_hours(period)))
        self.cutover, self.check = jobs.validated(self.cutover, now, a == b, mismatch=a != b), False
        self.agreed = newest if a == b and end == self.watermark else 0 if a != b else self.agreed

    def pricing_repair(self, now: datetime, dirty: list[datetime]) -> None:
        began, asked = time.monotonic(), self.priced_by()
        got = self.store.repair_pricing(str(self.start.replace(tzinfo=None)), str(now.replace(tzinfo=None)), self.limit)
        self.limit = jobs.next_limit(self.limit, got["scanned"], int(1000 * (time.monotonic() - began)), False, LEAST, MOST)
        self.repaired = None if got["has_more"] or got["scanned"] else asked

    def quarter_hours(self, now: datetime, dirty: list[datetime]) -> None:
        todo = rollup.next_buckets(self.watermark, dirty, now, self.batch)
        self.store.compact_buckets(todo)
        self.watermark += rollup.WIDTH * sum(b >= self.watermark for b in todo)

    def zones(self, now: datetime, dirty: list[datetime]) -> None:
        """The local days that changed; of a zone that is new, all.  Zones that are equally far are rolled up in one pass."""
        newest = self.store.newest_compaction()
        for after in sorted({self.rolled.get(z, 0) for z in self.names}):
            self.store.roll_zones([z for z in self.names if self.rolled.get(z, 0) == after], after, newest)
        self.rolled = {z: newest for z in self.names}

    def plan(self, start: datetime, end: datetime, mode: str = "auto", zone: str | None = None) -> layers.Layers:
        """Which layer answers which part of a period; zone: the one by whose days the question groups, if any."""
        if jobs.layer(mode, self.cutover, jobs.Cutover()) == "raw":
            return layers.Layers(((start, end),))
        # The same question is planned once for what there is.
        state = self.store.snapshots.load()
        there = [state.get(name) for name in ("dirty", "compacted", "zone_notes")] + [self.watermark]
        if self.planned[0] != there or len(self.planned[1]) >= PLANS:
            self.planned = there, {}
        plans = self.planned[1]
        if (start, end, zone) not in plans:
            plans[start, end, zone] = self._planned(start, end, zone)
        return plans[start, end, zone]

    def _planned(self, start: datetime, end: datetime, zone: str | None) -> layers.Layers:
        pending = self.store.pending_buckets().where((F.col("bucket") > F.lit(start - rollup.WIDTH)) & (F.col("bucket") < F.lit(end)))
        dirty = [datetime.fromtimestamp(r[0], self.start.tzinfo) for r in pending.select(F.unix_seconds("bucket")).distinct().collect()]  # 96 a day
        ready = self.store.ready_days(zone, start, end) if zone in self.names else frozenset()
        return layers.layered(start, end, self.start, self.watermark, dirty, zone if ready else None, ready)

    def source(self, start: datetime, end: datetime, mode: str = "auto", zone: str | None = None):
        """What a question over a period reads: local days of its zone, 15-minute rows, and raw events where neither holds."""
        return self.read(self.plan(start, end, mode, zone), start)

    def read(self, p: layers.Layers, start: datetime):
        raw = self.store.events((p.raw[0][0], p.raw[-1][1])) if p.raw else self.store.events((start, start))
        if not (p.rollup or p.days):
            return layers.inside(raw, p.raw)
        rows = self.store.quarter_hours((p.rollup[0][0], p.rollup[-1][1])) if p.rollup else self.store.quarter_hours((start, start))
        return layers.stitched(raw, rows, self.store.zone_days(p.zone, (p.days[0][0], p.days[-1][1])) if p.days else None, p)
