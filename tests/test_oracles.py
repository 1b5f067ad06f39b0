"""Every query with SQL of its own against DuckDB over the same tables."""

import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, date, datetime, timedelta
from threading import Event
from time import sleep

import pytest
from compare import both, connection
from pyspark.sql import functions as F

import meterlake.control_queries
import meterlake.distinct_queries
import meterlake.inventory_queries
import meterlake.queries as Q
import meterlake.reading_queries
import meterlake.state_queries
from meterlake.functions import cursor
from meterlake.operators import history
from meterlake.plans import answers, jobs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, con, name):
    got, want, got_kinds, want_kinds = both(spark, con, Q.QUERIES[name], Q.ORACLES[name], SF)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    assert {c: same.get(k, k) for c, k in got_kinds.items()} == want_kinds


def test_insights_of_all_rules(spark):
    rules = {r.rule for r in Q.QUERIES["alg14_insights"](spark, SF).collect()}
    assert {"usage.new", "sessions.increase", "tokens.increase", "tokens.decrease"} <= rules and any(x.startswith("composition.") for x in rules)


def test_turns_take_the_nearest_free_event(spark):
    """Each turn in order, against a plain loop; with few instants, so that turns compete and times tie."""
    rng = random.Random(6)
    for tolerance, span in ((10_000, 60_000), (3, 12), (10**9, 40), (40, 4000), (90_000, 1 << 25)):
        turns = [(s, k, rng.randrange(span)) for s in range(6) for k in range(rng.randrange(40))]
        usage = [(s, e, rng.randrange(span)) for s in range(1, 7) for e in range(rng.randrange(40))]
        want = set()
        for s in range(7):
            free = sorted((ts, e) for x, e, ts in usage if x == s)
            for ts, k in sorted((ts, k) for x, k, ts in turns if x == s):
                best = min(free, key=lambda u: (abs(u[0] - ts), u), default=None)
                if best and abs(best[0] - ts) <= tolerance:
                    free.remove(best)
                    want.add((s, k, best[1]))
        got = history.matched(spark.createDataFrame(turns, "session int, key int, ts_ms long"), spark.createDataFrame(usage, "session int, event int, ts_ms long"), tolerance)
        assert {tuple(r) for r in got.collect()} == want


def test_next_progress_and_windows_agree_with_the_driver(spark):
    """The relations give what the functions for one coordinator give."""
    at, q = datetime(2024, 3, 9, tzinfo=UTC), timedelta(minutes=15)
    rng, states, dirty, want = random.Random(2), [], [], set()
    for i in range(60):
        start = at + rng.randrange(20) * q
        end, mark = start + rng.randrange(-2, 30) * q + timedelta(minutes=rng.choice([0, 7])), rng.choice([None, at + rng.randrange(60) * q])
        pace, bad = rng.choice([0.0, 0.5, 2.0]), [at + rng.randrange(60) * q for _ in range(rng.randrange(8))]
        states.append((i, start, end, mark, pace))
        dirty += [(i, b) for b in bad]
        p = jobs.progress(start, end, mark, bad, pace)
        want.add((i, p.completed, p.total, p.remaining, p.eta_minutes))
    got = jobs.progress_of(spark.createDataFrame(states, "id int, start timestamp, end timestamp, watermark timestamp, per_minute double"), spark.createDataFrame(dirty, "id int, bucket timestamp"))
    assert {(r.id, r.completed, r.total, r.remaining, r.eta_minutes) for r in got.collect()} == want
    zones = [(0, "Asia/Seoul", date(2024, 1, 30)), (1, "America/New_York", date(2024, 3, 12)), (2, "America/Santiago", date(2024, 9, 9)), (3, "Etc/UTC", date(2024, 2, 29))]
    rows = jobs.prewarm_windows(spark.createDataFrame(zones, "id int, zone string, today date")).collect()
    assert Counter(tuple(r) for r in rows) == Counter((i, u, a.replace(tzinfo=None), b.replace(tzinfo=None)) for i, z, t in zones for u, a, b in jobs.prewarm(t, z))


def test_signed_cursors():
    now = datetime(2024, 1, 2, 3, 4, 5, 678000, tzinfo=UTC)
    c = cursor.Cursor(now, now + timedelta(days=1), cursor.Place(now, "s/é"), cursor.Place(now, "k"), "12")
    text = cursor.encode(c, "user:1", "secret")
    assert cursor.decode(text, "user:1", "secret") == c and cursor.decode(cursor.encode(cursor.Cursor(now, c.end), "", "x"), "", "x") == cursor.Cursor(now, c.end)
    payload, signature = text.split(".")
    for bad in (None, "", payload, f"{payload}.", f".{signature}", f"{payload}.{signature}.x", f"{payload}x.{signature}", f"{payload}.{signature[:-2]}AA", "é.ü"):
        assert cursor.decode(bad, "user:1", "secret") is None, bad
    assert cursor.decode(text, "user:2", "secret") is None and cursor.decode(text, "user:1", "other") is None
    for bad in (cursor.Cursor(now, now), cursor.Cursor(now, c.end, cursor.Place(now, "")), cursor.Cursor(now, c.end, None, c.after), cursor.Cursor(now, c.end, None, c.after, "1x")):
        with pytest.raises(ValueError):
            cursor.encode(bad, "", "x")
    with pytest.raises(ValueError):
        cursor.decode(text, "user:1", "")


def test_layers_are_watched_alike(spark):
    """The fold over looks gives what the functions for one layer give."""
    rng, rows, want = random.Random(3), [], {}
    for i in range(40):
        at, c, looks = datetime(2024, 1, 1, tzinfo=UTC), jobs.Cutover(), []
        soon, well = rng.choice([0.98, 0.6]), rng.choice([0.98, 0.6])
        for _ in range(rng.randrange(1, 300)):
            at += timedelta(seconds=rng.choice([30, 60, 400, 7200 if rng.random() < 0.1 else 60]))
            ready, sound = rng.random() < (soon if len(looks) < 150 else 0.5), rng.random() < well
            c, check = jobs.observe(c, at, ready)
            if check:
                c = jobs.validated(c, at, sound)
            looks.append((int(at.timestamp()), ready, sound))
        rows.append((i, looks))
        want[i] = (c.state, c.healthy, c.failures, int(c.checked.timestamp()), c.validated and int(c.validated.timestamp()))
    df = spark.createDataFrame(rows, "id int, looks array<struct<at: long, ready: boolean, sound: boolean>>")
    assert {r.id: tuple(r.c) for r in df.select("id", jobs.watched(F.col("looks")).alias("c")).collect()} == want
    assert len({w[0] for w in want.values()}) >= 3


def test_answers_age():
    at = [0.0]

    class Frame:
        def persist(self):
            return self

        def count(self):
            return 1

        def unpersist(self):
            at.append("gone")

    kept = answers.Answers(10, lambda: at[0])
    a = kept.ask("q", Frame)
    at[0] = 9.9
    assert kept.ask("q", Frame) is a and kept.computed == 1
    at[0] = 10.0
    assert kept.ask("q", Frame) is not a and kept.computed == 2 and at[1:] == ["gone"]
    with pytest.raises(ZeroDivisionError):
        kept.ask("bad", lambda: 1 / 0)
    assert kept.ask("bad", Frame) and kept.computed == 3
    at[0] = 19.9
    kept.ask("q2", Frame)
    assert set(kept.kept) == {"q", "bad", "q2"}
    at[0] = 25.0
    kept.ask("q3", Frame)
    assert set(kept.kept) == {"q2", "q3"} and kept.waiting == {}  # what others asked goes with its age
    kept.forget()
    assert not kept.kept and at[1:] == ["gone"] * 5


def test_answers_are_shared_while_they_are_computed():
    go, asked = Event(), []

    class Frame:
        def persist(self):
            asked.append(1)
            return self

        def count(self):
            go.wait(10)

        def unpersist(self):
            pass

    kept = answers.Answers(10)
    with ThreadPoolExecutor(6) as pool:
        found = [pool.submit(kept.ask, "q", Frame) for _ in range(6)]
        while not asked:
            sleep(0.01)
        go.set()
        assert len({id(f.result()) for f in found}) == 1 and asked == [1] and kept.computed == 1

        def bad():
            raise ValueError

        with pytest.raises(ValueError):
            kept.ask("bad", bad)
        assert kept.waiting == {}
