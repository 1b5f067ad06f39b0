"""Which layer answers which part of a period: whole local days of a zone, 15-minute rows, or raw events.

Parts are sets of half-open intervals.  Buckets that changed since they were compacted are holes in the rollup, and only the
holes are read raw, wherever they are.  Of what is left, a local day that lies in it whole and was rolled up after its last
compaction is taken from the zone's days.  Every instant of the period is in exactly one part.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import timeutil
from .rollup import DIMENSIONS, SUMS, WIDTH

Span = tuple[datetime, datetime]
#: Intervals up to which a part is a filter that reaches the scan; beyond, its buckets are joined.
FILTERED = 64


def floored(t: datetime) -> datetime:
    return t - timedelta(seconds=t.timestamp() % WIDTH.total_seconds())


def coalesced(buckets: Iterable[datetime]) -> list[Span]:
    """The intervals that buckets cover, neighbours joined."""
    out: list[Span] = []
    for b in sorted(set(buckets)):
        if out and out[-1][1] == b:
            out[-1] = (out[-1][0], b + WIDTH)
        else:
            out.append((b, b + WIDTH))
    return out


def minus(spans: Iterable[Span], holes: list[Span]) -> list[Span]:
    """What is left of intervals without others; both in order and apart."""
    out, k = [], 0
    for a, b in spans:
        while k and holes[k - 1][1] > a:
            k -= 1
        while k < len(holes) and holes[k][0] < b:
            x, y = holes[k]
            if a < x:
                out.append((a, min(x, b)))
            a = max(a, y)
            k += 1
        if a < b:
            out.append((a, b))
    return out


def joined(spans: Iterable[Span]) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class Layers:
    raw: tuple[Span, ...]
    rollup: tuple[Span, ...] = ()
    days: tuple[tuple[str, str], ...] = ()  # runs of local days, both ends included
    zone: str | None = None


def layered(start: datetime, end: datetime, begun: datetime, watermark: datetime, dirty: Iterable[datetime], zone: str | None = None, ready: frozenset[str] = frozenset()) -> Layers:
    """begun and watermark: between which all buckets were compacted; dirty: buckets that changed since; ready: the zone's
    local days that are rolled up as the buckets are now."""
    a = floored(start)
    a, b = max(begun, a if a == start else a + WIDTH), floored(min(end, watermark))
    clean = minus([(a, b)] if a < b else [], coalesced(floored(d) for d in dirty))
    raw = minus([(start, end)] if start < end else [], clean)
    runs: list[list[date]] = []
    taken: list[Span] = []
    for x, y in clean if zone else []:
        day = x.astimezone(timeutil.zone(zone)).date()
        while (span := (timeutil.first_instant(day, zone), timeutil.first_instant(day + timedelta(days=1), zone)))[0] < y:
            if x <= span[0] and span[1] <= y and str(day) in ready and span[0] < span[1]:
                taken.append(span)
                if runs and runs[-1][1] + timedelta(days=1) == day:
                    runs[-1][1] = day
                else:
                    runs.append([day, day])
            day += timedelta(days=1)
    return Layers(tuple(raw), tuple(minus(clean, joined(taken))), tuple((str(p), str(q)) for p, q in runs), zone)


def inside(df: DataFrame, spans: Iterable[Span]) -> DataFrame:
    """Rows whose ts is in one of the intervals (in order and apart): a filter, or a join of as many buckets as they have."""
    spans = list(spans)
    if not spans:
        return df.where("false")
    within = lambda a, b: (F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))
    if len(spans) <= FILTERED:
        return df.where(reduce(Column.__or__, [within(*s) for s in spans]))
    # All edges but the first and the last are edges of buckets.
    buckets = [(floored(a) + i * WIDTH,) for a, b in spans for i in range(-(-(b - floored(a)) // WIDTH))]
    held = df.sparkSession.createDataFrame(buckets, "span_bucket timestamp")
    return df.where(within(spans[0][0], spans[-1][1])).join(held, X.bucket_start("ts") == F.col("span_bucket"), "left_semi")


def stitched(events: DataFrame, quarter_hours: DataFrame, zone_days: DataFrame | None, p: Layers) -> DataFrame:
    """One relation over all parts, filters inside each branch; rows of a day have its first instant.  Every aggregate
    by days of the zone (or by anything, without a zone) equals that over raw events."""
    parts = [inside(events, p.raw)] if p.raw or not (p.rollup or p.days) else []
    if p.rollup:
        parts.append(inside(quarter_hours, p.rollup))
    if p.days:
        between = reduce(Column.__or__, [F.col("day").between(a, b) for a, b in p.days])
        parts.append(zone_days.where(between).withColumn("ts", X.first_instant(F.col("day"), F.lit(p.zone)).cast("timestamp")))
    parts = [x.select("ts", *DIMENSIONS, *SUMS, F.col("cost_usd").cast("decimal(28,8)").alias("cost_usd")) for x in parts]
    return reduce(DataFrame.unionByName, parts)
