"""Calendar arithmetic in named zones, on the driver: periods, presets, first instants of days."""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones


@dataclass(frozen=True)
class Period:
    """Half-open, in UTC."""

    start: datetime
    end: datetime


def zone(name: str) -> ZoneInfo:
    if name not in available_timezones():
        raise ValueError(f"not a time zone: {name!r}")
    return ZoneInfo(name)


def first_instant(day: date, name: str) -> datetime:
    """The first instant that exists on a local date, in UTC, also where midnight is skipped."""
    z = zone(name)
    low = datetime(day.year, day.month, day.day, tzinfo=UTC) - timedelta(hours=48)
    lo, hi = 0, 96 * 3600
    while lo < hi:  # the least second whose local date is the day or later
        mid = (lo + hi) // 2
        if (low + timedelta(seconds=mid)).astimezone(z).date() >= day:
            hi = mid
        else:
            lo = mid + 1
    return low + timedelta(seconds=lo)


def add_months(day: date, n: int) -> date:
    """The same day n months on, or the month's last."""
    k = day.year * 12 + day.month - 1 + n
    y, m = divmod(k, 12)
    return date(y, m + 1, min(day.day, monthrange(y, m + 1)[1]))


def week_start(day: date) -> date:
    """The Sunday on or before a day."""
    return day - timedelta(days=(day.weekday() + 1) % 7)


def preset(name: str, now: datetime, tz: str, earliest: datetime | None = None) -> Period:
    """today, week, month, quarter, year, 7d, 30d, 90d or all, up to the end of the local day of now."""
    today = now.astimezone(zone(tz)).date()
    end = first_instant(today + timedelta(days=1), tz)
    if name == "all":
        return Period(earliest or datetime(1970, 1, 1, tzinfo=UTC), end)
    starts = {"today": today, "week": week_start(today), "month": today.replace(day=1), "quarter": today.replace(month=(today.month - 1) // 3 * 3 + 1, day=1), "year": today.replace(month=1, day=1)}
    starts |= {f"{n}d": today - timedelta(days=n - 1) for n in (7, 30, 90)}
    return Period(first_instant(starts[name], tz), end)


def previous(p: Period, name: str | None = None, tz: str | None = None) -> Period:
    """The day, week, month, quarter or year before, for a preset of that name in a zone; else the same length just before."""
    if tz is None or name not in ("today", "week", "month", "quarter", "year"):
        return Period(p.start - (p.end - p.start), p.start)
    first = p.start.astimezone(zone(tz)).date()
    months = {"month": 1, "quarter": 3, "year": 12}.get(name)
    before = add_months(first.replace(day=1), -months) if months else first - timedelta(days=7 if name == "week" else 1)
    return Period(first_instant(before, tz), first_instant(first, tz))


def anchor(now: datetime, minutes: int = 10) -> datetime:
    """Now, floored, so that questions within the same minutes are the same."""
    return now - timedelta(seconds=now.timestamp() % (minutes * 60))


def insight_pair(name: str, tz: str, now: datetime) -> tuple[Period, Period]:
    """7 (days), week or month up to now, and as much of the one before as has passed of this one, its end at most."""
    if name == "7":
        current = Period(now - timedelta(days=7), now)
        return current, previous(current)
    today = now.astimezone(zone(tz)).date()
    start = week_start(today) if name == "week" else today.replace(day=1)
    before = start - timedelta(days=7) if name == "week" else add_months(start, -1)
    a, b = first_instant(before, tz), first_instant(start, tz)
    return Period(b, now), Period(a, min(b, a + (now - b)))


def clamped(p: Period, tz: str, days: int = 366) -> Period:
    """The last `days` local days of a period."""
    last = (p.end - timedelta(microseconds=1)).astimezone(zone(tz)).date()
    return Period(max(p.start, first_instant(last - timedelta(days=days - 1), tz)), p.end)


def utilization_periods(today: date, tz: str) -> tuple[Period, Period]:
    """The last 7 complete local days, and the 28 days before them."""
    at = lambda n: first_instant(today - timedelta(days=n), tz)
    return Period(at(7), at(0)), Period(at(35), at(7))
