"""The planner of layers against single minutes, questions from it against raw events, and tables in segments."""

import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_store import SF, rows, store  # noqa: F401  (a fixture)

from meterlake.functions import timeutil
from meterlake.operators.usage import Scope
from meterlake.plans import jobs, layers, rollup, snapshots
from meterlake.plans.maintenance import Maintenance
from meterlake.sources import tables as T

MINUTE = timedelta(minutes=1)


@pytest.mark.parametrize("zone", [None, "America/New_York", "Asia/Kathmandu"])
def test_planner_by_minutes(zone):
    """Over a change of clocks: each minute is in the part in which it belongs, and only there."""
    rng, at = random.Random(3), datetime(2024, 3, 8, tzinfo=UTC)
    for _ in range(15):
        start = at + rng.randrange(3 * 1440) * MINUTE
        end = start + rng.randrange(4 * 1440) * MINUTE
        begun, mark = at + rng.randrange(100) * rollup.WIDTH, at + rng.randrange(200, 800) * rollup.WIDTH
        dirty = {at + rng.randrange(700) * rollup.WIDTH for _ in range(rng.choice([0, 1, 5, 90]))}
        ready = frozenset(str(date(2024, 3, 7) + timedelta(days=i)) for i in range(9) if rng.random() < 0.7)
        p = layers.layered(start, end, begun, mark, dirty, zone, ready)
        covered, whole = [], {}
        for a, b in p.days:
            first, after = date.fromisoformat(a), date.fromisoformat(b) + timedelta(days=1)
            covered.append((timeutil.first_instant(first, zone), timeutil.first_instant(after, zone)))
        holds = lambda spans, t: sum(a <= t < b for a, b in spans)
        clean = lambda b: begun <= b and start <= b and b + rollup.WIDTH <= min(end, mark) and b not in dirty
        for i in range(rng.randrange(15), 8 * 1440, 15):
            t = at - timedelta(days=1) + i * MINUTE
            raw, quarter, day = holds(p.raw, t), holds(p.rollup, t), holds(covered, t)
            assert raw + quarter + day == (start <= t < end)
            assert raw == (start <= t < end and not clean(layers.floored(t)))
            if zone and start <= t < end:
                local = t.astimezone(timeutil.zone(zone)).date()
                if local not in whole:
                    x, y = timeutil.first_instant(local, zone), timeutil.first_instant(local + timedelta(days=1), zone)
                    whole[local] = str(local) in ready and all(clean(x + k * rollup.WIDTH) for k in range((y - x) // rollup.WIDTH))
                assert day == whole[local]
            else:
                assert not day


def test_inside_by_filter_and_by_join(spark, monkeypatch):
    at = lambda m: datetime(2024, 1, 1, tzinfo=UTC) + m * MINUTE
    df = spark.createDataFrame([(at(i),) for i in range(400)], "ts timestamp")
    spans = [(at(7), at(30)), (at(45), at(60)), (at(90), at(120)), (at(300), at(311))]
    want = {at(i) for i in range(400) if any(a <= at(i) < b for a, b in spans)}
    for most in (64, 2):
        monkeypatch.setattr(layers, "FILTERED", most)
        got = [r.ts.astimezone(UTC) for r in layers.inside(df, spans).collect()]
        assert len(got) == len(want) and set(got) == want


ZONES = ("Asia/Seoul", "America/New_York")
START, NOW = datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 20, 1, tzinfo=UTC)


@pytest.fixture
def served(spark, store):  # noqa: F811
    """A store of ten days whose rollups are complete and active."""
    store.save_usage_events(T.usage_events(spark, SF))
    m = Maintenance(store, START, 2000, ZONES)
    m.quarter_hours(NOW, [])
    m.zones(NOW, [])
    m.cutover = jobs.Cutover("active", 3600, 0, NOW, NOW)
    store.serve_from(m)
    return store, m


def questions(s):
    scope, other = Scope("2024-01-08 05:07", "2024-01-20 00:00"), Scope("2024-01-11", "2024-01-17", provider="view")
    return [rows(x) for x in (s.overview(scope), s.daily_series(scope), s.daily_series(scope, zone=ZONES[1]), s.daily_series(scope, "hour"), s.member_series(other), s.model_series(scope), s.leaderboard(other), s.provider_breakdown(scope), s.user_usage(other)["by_host"], s.overview(Scope("2024-01-11", "2024-01-17", team=1)))]


def test_questions_from_three_layers(spark, served):
    store, m = served  # noqa: F811
    end = datetime(2024, 1, 20, tzinfo=UTC)

    def agree():
        store.layers = None
        want = questions(store)
        store.layers = m
        assert questions(store) == want

    p = m.plan(START, end, zone=ZONES[0])
    assert p.raw == () and p.days == (("2024-01-11", "2024-01-19"),) and len(p.rollup) == 2
    agree()
    days = m.source(START, end, zone=ZONES[0]).where("hour(ts) = 15").select("ts").distinct().count()
    assert days >= 9  # a day's rows have its first instant
    # Three buckets change: they alone are read raw, and only their days come from 15-minute rows.
    three = store.events().where("ts >= '2024-01-12' AND ts < '2024-01-20'").select("ts", "dedup_key", "user_id", "provider_key").orderBy("ts").collect()
    for r in (three[0], three[len(three) // 3], three[len(three) // 2]):
        store.reconcile_usage(r.user_id, r.provider_key, spark.createDataFrame([(r.dedup_key,)], "dedup_key string"))
    p = m.plan(START, end)
    assert len(p.raw) == 3 and all(b - a == rollup.WIDTH for a, b in p.raw) and not p.days
    raw = m.source(START, end)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"{a:%Y-%m-%d %H:%M}" in raw for a, _ in p.raw)  # as filters of the scan
    zoned = m.plan(START, end, zone=ZONES[0])
    assert zoned.raw == p.raw and 5 <= sum((date.fromisoformat(b) - date.fromisoformat(a)).days + 1 for a, b in zoned.days) <= 8
    agree()
    # Compacted again, but not yet rolled up: no raw reads, and the days come back with the next roll-up.
    m.quarter_hours(NOW, m.dirty(9))
    stale = m.plan(START, end, zone=ZONES[0])
    assert stale.raw == () and stale.days == zoned.days
    agree()
    m.zones(NOW, [])
    assert m.plan(START, end, zone=ZONES[0]).days == (("2024-01-11", "2024-01-19"),)
    agree()
    # A zone that is new gets all its days.
    late = Maintenance(store, START, 16, (*ZONES, "Asia/Kathmandu"))
    late.watermark, late.cutover, late.rolled = m.watermark, m.cutover, dict(m.rolled)
    assert late.plan(START, end, zone="Asia/Kathmandu").days == ()
    late.zones(NOW, [])
    assert len(late.plan(START, end, zone="Asia/Kathmandu").days) == 1


def test_days_answer_from_sums_and_sets(spark, served):
    """No row of a session is read where days are whole; sessions and users that no rollup has seen are counted beside."""
    store, m = served  # noqa: F811
    whole, ragged = Scope("2024-01-10 15:00", "2024-01-19 15:00"), Scope("2024-01-08 05:07", "2024-01-20 00:00", provider="view")
    read = {f.split("/segment=")[0].rsplit("/", 1)[1] for f in store.daily_series(whole).inputFiles()}
    assert read == {"zone_sums", "zone_sets", "zone_notes"}
    assert store._by_sets(Scope("2024-01-10", "2024-01-20", user=7), ZONES[0]) is None and store._by_sets(whole, "Asia/Tokyo") is None
    one = T.usage_events(spark, SF).where("ts >= '2024-01-14' AND ts < '2024-01-15' AND provider_key = 'view'").limit(1)
    new = one.withColumns({"dedup_key": F.lit("new"), "session_id": F.lit("a session of its own"), "user_id": F.lit(987654).cast("long"), "ts": F.col("ts") + F.expr("interval 1 minute")})
    store.save_usage_events(new)
    for looks in range(3):
        asked = lambda s: [rows(x) for x in (s.overview(whole), s.overview(ragged), s.daily_series(whole), s.daily_series(ragged, zone=ZONES[1]), s.provider_breakdown(whole), s.provider_breakdown(ragged))]
        got, store.layers = asked(store), None
        assert asked(store) == got
        store.layers = m
        if looks == 0:
            m.quarter_hours(NOW, m.dirty(9))
        elif looks == 1:
            m.zones(NOW, [])
    numbers = store.table("numbers")
    assert numbers.count() == numbers.select("of", "value").distinct().count() == numbers.select("of", "number").distinct().count()
    assert numbers.where("value = 'a session of its own'").count() == 1


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    """However many appends, few segments; what was superseded is gone; a lost merge changes nothing."""
    total = lambda rows, read: rows.groupBy("k").agg(F.max("v").alias("v"))
    s = snapshots.Snapshots(spark, str(tmp_path), {"t": total, "u": total}, fan=3, grace=0)
    at = lambda i: spark.range(1).select(F.lit(i % 5).alias("k"), F.lit(i).alias("v"))
    assert s.read("t") is None
    most = 0
    for i in range(40):
        s.append(("t", at(i), ()), *([("u", at(i), ("k",))] if i % 10 == 0 else []))
        most = max(most, len(s.load()["t"]))
    assert most <= 2 * 4 and s.load()["writes"] == {"t": 40, "u": 4}
    assert rows(total(s.read("t"), None)) == [(k, 35 + k) for k in range(5)]
    assert s.read("t").count() < 30 and len(list((tmp_path / "t").iterdir())) == len(s.load()["t"])
    assert len(list((tmp_path / "manifest").glob("0*.json"))) <= snapshots.KEPT
    s.append(("t", at(0).where("false"), ()))  # no rows, no segment
    before = s.load()["t"]
    while sum(x[1] == 0 for x in s.load()["t"]) != 2:
        s.append(("t", at(7), ()))
    save, calls = s.files.save, []

    def lost(state):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        save(state)

    monkeypatch.setattr(s.files, "save", lost)
    with pytest.raises(OSError):
        s.append(("t", at(100), ()))
    monkeypatch.undo()
    assert before and rows(total(s.read("t"), None))[0] == (0, 100)
    s.merge("t", ())
    s.sweep("t")
    assert rows(total(s.read("t"), None))[0] == (0, 100) and len(list((tmp_path / "t").iterdir())) == len(s.load()["t"])


def test_many_ticks_leave_few_files(spark, store):  # noqa: F811
    """Marks and compactions of many ticks: what a look at pending buckets reads stays flat."""
    store.snapshots.fan = 4
    one = T.usage_events(spark, SF).limit(1)
    store.save_usage_events(one)
    files = []
    for i in range(48):
        bucket = START + i % 7 * rollup.WIDTH
        store._segments(dirty=spark.createDataFrame([(bucket, 2 * i + 1)], "bucket timestamp, mark long"))
        store._segments(compacted=spark.createDataFrame([(bucket, 2 * i + 2)], "bucket timestamp, mark long"))
        files.append(sum(len(store.snapshots.load().get(n, [])) for n in ("dirty", "compacted")))
    assert max(files) <= 2 * 3 * 3 + 1 and max(files[32:]) <= max(files[:32]) + 3
    assert store.pending_buckets().count() == 1  # that of the event
    assert store.table("dirty").count() < 30 and store.table("compacted").count() < 30
