"""The store: idempotent saves, repair and withdrawal, and questions that equal those on plain frames."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake.functions import exprs as X
from meterlake.operators import ingest, pricing, usage
from meterlake.operators.usage import Scope
from meterlake.plans import jobs, outbox, rollup
from meterlake.sources import tables as T
from meterlake.state_queries import NOW, candidates
from meterlake.store import UsageStore

SF = "/root/testdata/sf0.001"
ALL = Scope("2023-01-01", "2025-01-01")


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return UsageStore(spark, str(tmp_path), T.revisions(spark), T.assignments(spark, SF), T.users(spark, SF), T.teams(spark, SF), "Asia/Seoul", ("click", "view"))


def wanted(spark):
    """What the store should hold after all events were saved."""
    p = pricing.priced(T.usage_events(spark, SF), T.revisions(spark))
    p = p.withColumns({"cost_usd": F.col("price").cast("decimal(18,8)"), "cost_status": F.col("status")})
    return ingest.attributed(p.drop("price", "status"), T.assignments(spark, SF))


def test_empty(store):
    assert store.overview(ALL).first().sessions == 0
    assert store.leaderboard(ALL).count() == store.user_hosts(1).count() == store.reconcile_rollups("2023-01-01", "2025-01-01").count() == 0


def test_saved_once(spark, store):
    e = T.usage_events(spark, SF)
    n = e.count()
    assert store.save_usage_events(e.where("event_id % 3 = 0").unionByName(e.where("event_id % 3 = 0")))["inserted"] == e.where("event_id % 3 = 0").count()
    assert store.save_usage_events(e)["deduped"] == e.where("event_id % 3 = 0").count()
    assert store.save_usage_events(e) == {"inserted": 0, "deduped": n}
    plain = usage.scan(wanted(spark), ALL)
    assert rows(store.overview(ALL)) == rows(usage.overview(plain))
    assert rows(store.daily_series(ALL)) == rows(usage.series(plain, "Asia/Seoul"))
    assert rows(store.leaderboard(ALL, "team", "tokens")) == rows(usage.leaderboard(plain, T.teams(spark, SF), "team_id", "tokens"))
    assert rows(store.organization_dashboard(ALL, ALL)["users"]) == rows(usage.leaderboard(plain, T.users(spark, SF), "user_id"))
    store.recompute_daily(["2024-01-16", "2024-01-17"])
    mart = ingest.daily_mart(plain, "Asia/Seoul", "user_id").where("day IN ('2024-01-16', '2024-01-17')")
    assert rows(store.table("user_days").withColumn("day", F.col("day").cast("string"))) == rows(mart)


def test_repair(spark, store):
    """Events are saved without any price; then prices are known."""
    prices, store.revisions = store.revisions, store.revisions.where("false")
    e = T.usage_events(spark, SF)
    store.save_usage_events(e)
    store.compact("2023-01-01", "2025-01-01")
    assert store.reconcile_rollups("2023-01-01", "2025-01-01").count() == 0
    store.revisions = prices
    recovered = 0
    while True:
        got = store.repair_pricing("2023-01-01", "2025-01-01", 300)
        recovered += got["recovered"]
        if not got["has_more"]:
            break
    want = wanted(spark)
    assert recovered == want.where("cost_status = 'priced'").count() > 300
    cols = ["event_id", "cost_status", "cost_usd", "team_id", "revision_id"]
    assert rows(store.events().select(*cols)) == rows(want.select(*cols))
    assert store.repair_pricing("2023-01-01", "2025-01-01")["scanned"] == 0
    assert store.reconcile_rollups("2023-01-01", "2025-01-01").count() > 0
    store.compact("2023-01-01", "2025-01-01")
    assert store.reconcile_rollups("2023-01-01", "2025-01-01").count() == 0


def test_teams_and_withdrawal(spark, store):
    e = T.usage_events(spark, SF)
    store.save_usage_events(e)
    user = e.where("user_id % 10 = 9").select("user_id").first()[0]
    n = e.where(F.col("user_id") == user).count()
    assert store.preview_unassigned(Scope(ALL.start, ALL.end, user=user)).first().events == n
    got = store.backfill_unassigned(user, 4, ALL.start, ALL.end, n - 1)
    assert (got["updated"], got["has_more"]) == (n - 1, True)
    assert store.backfill_unassigned(user, 4, ALL.start, ALL.end)["updated"] == 1
    assert store.events().where((F.col("user_id") == user) & (F.col("team_id") == 4)).count() == n
    keys = e.where("event_id % 2 = 0").select("dedup_key")
    gone = e.where((F.col("user_id") == user) & (F.col("provider_key") == "view") & (F.col("event_id") % 2 == 0))
    assert store.reconcile_usage(user, "view", keys)["reconciled"] == gone.count()
    assert store.events().count() == e.count() - gone.count()
    assert store.save_usage_events(e)["inserted"] == gone.count()  # a withdrawn key may come back
    assert store.events().count() == store.events().select("dedup_key").distinct().count() == e.count()


def test_same_rules(spark):
    """The expressions choose and limit as the functions on the driver do."""
    c = candidates(spark, SF).where("k <= 60")
    found = {r.k: r.task for r in jobs.first_tasks(c, NOW, "k").collect()}
    utc = lambda x: x and x.astimezone(UTC)
    by = {}
    for r in c.collect():
        by.setdefault(r.k, []).append(jobs.Candidate(r.task, r.due, utc(r.next_attempt), utc(r.last_started), utc(r.eligible_since)))
    assert found == {k: t for k, v in by.items() if (t := jobs.next_task(v, NOW))}
    cases = [(limit, done, ms, failed) for limit in (1, 25, 101, 499, 900) for done in (0, 101, 900) for ms in (0, 2000, 2001, 10_000) for failed in (False, True)]
    df = spark.createDataFrame(cases, "a int, b int, c int, d boolean")
    assert [r[4] for r in df.select("*", jobs.limit_after(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 25, 500)).collect()] == [jobs.next_limit(*x, 25, 500) for x in cases]


def test_watermark_and_outbox(spark):
    at = lambda n: NOW + timedelta(minutes=15 * n)
    mark = lambda *n: rollup.advanced(at(0), spark.createDataFrame([(at(i),) for i in n], "bucket timestamp"), at(50)).first()[0].astimezone(UTC)
    assert mark() == mark(1, 2) == at(0)
    assert mark(0, 1, 1, 3) == at(2)
    late = rollup.advanced(NOW - timedelta(days=500), spark.createDataFrame([], "bucket timestamp"), NOW)
    assert late.first()[0].astimezone(UTC) == NOW - timedelta(days=400)
    same = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (3, "a")], "batch_id int, dedup_key string")
    t = {r.batch_id: r.token for r in outbox.tokens(same).collect()}
    assert t[1] == t[2] != t[3]


def test_maintenance(spark, store):
    """Ticks bring the rollup up to date and active; a change makes buckets dirty until the next ticks; the state lasts."""
    from meterlake.plans.maintenance import Maintenance

    e = T.usage_events(spark, SF).where("ts >= '2024-01-15' AND ts < '2024-01-15 06:00'")
    start, now = datetime(2024, 1, 15, tzinfo=UTC), datetime(2024, 1, 15, 6, 30, tzinfo=UTC)
    store.save_usage_events(e)
    m, ran = Maintenance(store, start, 16), []
    for n in range(5):
        ran.append(m.tick(now + timedelta(minutes=2 * n)))
        m = Maintenance(store, start, 16)
    assert ran == ["pricing_repair", "quarter_hours", "quarter_hours", "validation", None]  # nothing to price since the first
    assert m.cutover.state == "observing" and m.watermark >= datetime(2024, 1, 15, 6, tzinfo=UTC)
    m.cutover = jobs.Cutover("active", 3600, 0, now, now)
    end = datetime(2024, 1, 15, 6, tzinfo=UTC)
    same = lambda: rows(usage.overview(m.source(start, end))) == rows(usage.overview(m.source(start, end, "raw")))
    assert same() and m.dirty(9) == []
    one = store.events().orderBy("ts").limit(1)
    user, provider = one.first().user_id, one.first().provider_key
    assert store.reconcile_usage(user, provider, one)["reconciled"] == 1
    assert len(m.dirty(9)) == 1 and same()
    m.quarter_hours(now, m.dirty(9))
    assert m.dirty(9) == [] and same()
    got = store.quarter_hours().agg(F.sum("event_count")).first()[0]
    assert got == e.count() - 1


def scanned_months(df):
    """The partition filters of the plan's scans."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]


def test_questions_read_their_months(spark, store):
    store.save_usage_events(T.usage_events(spark, SF))
    store.reconcile_usage(3, "view", store.events().select("dedup_key"))
    scope = Scope("2024-01-15", "2024-01-25")
    asked = [store.overview(scope), store.daily_series(scope), store.leaderboard(scope), store.preview_unassigned(scope), store.utilization_usage(scope), store.insight_comparison(scope, Scope("2024-01-05", "2024-01-15"))["trend"]]
    for df in asked:
        filters = [f for f in scanned_months(df) if f]  # tables of labels have no partitions
        assert len(filters) >= 2 and all("event_month" in f and "2024-01" in f for f in filters), filters
    assert store.overview(Scope("2025-05-01", "2025-06-01")).first().sessions == 0
    assert rows(store.storage_stats().where("name = 'usage_events'").select("n")) == [(T.usage_events(spark, SF).count(),)]
    assert store.supports_zone("Asia/Seoul") and not store.supports_zone("seoul")


def test_weak_revisions_are_priced_again(spark, store):
    store.save_usage_events(T.usage_events(spark, SF))
    used = store.events().where("revision_id IS NOT NULL").select("revision_id").distinct().orderBy("revision_id").limit(1)
    n = store.events().join(used, "revision_id", "left_semi").count()
    out = store.repair_pricing("2023-01-01", "2025-01-01", 10_000, used)
    left = store.events().where("cost_status = 'priced'").join(used, "revision_id", "left_semi").count()
    assert n > 0 and left == n - out["repriced"] - out["recovered"] or left < n


def test_history_and_tools(spark, store):
    turns = spark.createDataFrame([(1, 0, "user", "# My request for X:\n  fix   it"), (1, 1, "assistant", "done"), (2, 0, "user", "<command-name>/model</command-name><command-args>fast</command-args>"), (2, 5, "assistant", "Fixed")], "session long, turn long, role string, text string").withColumn("user_id", F.lit(1))
    assert store.history_page(1)[0].count() == 0 and store.history_search(1, "fix", "key").turns.count() == 0 and store.tool_activity("2024-01-01", "2024-02-01")["tools"].count() == 0
    store.save_turns(turns)
    store.save_turns(turns)
    page, more = store.history_page(1, None, 1)
    assert [(r.session, r.turns) for r in page.collect()] == [(2, 2)] and more
    page, more = store.history_page(1, (5, 2), 1)
    assert [(r.session, r.preview) for r in page.collect()] == [(1, "fix it")] and not more
    assert {r.session for r in store.history_search(1, "FIX", "key").turns.collect()} == {1, 2}
    assert [(r.turn, r.meta, r.command) for r in store.history_session(1, 2).collect()] == [(0, True, "/model fast"), (5, False, None)]
    t = T.tool_events(spark, SF)
    store.save_tool_events(t)
    store.save_tool_events(t.limit(50))
    got = store.tool_activity("2024-01-15", "2024-01-25")
    from meterlake.operators import tools

    assert rows(got["summary"]) == rows(tools.summary(t.where("ts >= '2024-01-15' AND ts < '2024-01-25'")))


def test_search_in_pages(spark, store, monkeypatch):
    """Pages joined equal one search of all of a user's turns; blocks without the words aren't read; others' turns aren't found."""
    import random

    from meterlake import store as S

    monkeypatch.setattr(S, "BLOCK_BITS", 2)
    rng = random.Random(4)
    words = ["alpha", "béta", "gamma", "delta", "omega"]
    turns = [(u, s, t, "user", " ".join(rng.choices(words[:2 + (s // 4) % 4], k=6))) for u in (1, 2) for s in range(u * 100, u * 100 + 40) for t in range(3)]
    store.save_turns(spark.createDataFrame(turns[: len(turns) // 2], "user_id int, session long, turn long, role string, text string"))
    store.save_turns(spark.createDataFrame(turns[len(turns) // 2 - 9 :], "user_id int, session long, turn long, role string, text string"))
    for asked, size, blocks in (("OMEGA", 7, 3), ("béta al", 500, 4), ("a", 50, 2), ("nowhere", 5, 5)):
        want = sorted(((s, t) for u, s, t, _, x in turns if u == 1 and asked.lower() in x), reverse=True)
        got, after, read, passed = [], None, 0, 0
        for _ in range(60):
            page = store.history_search(1, asked, "key", after, size, blocks)
            found = [(r.session, r.turn) for r in page.turns.collect()]
            assert len(found) <= size and all(asked.lower() in r.snippet.lower() for r in page.turns.collect())
            got, after, read, passed = got + found, page.after, read + page.read, passed + page.passed
            if after is None:
                break
        assert got == want
    assert read == 0 and passed == 20  # of the words that are nowhere
    page = store.history_search(1, "OMEGA", "key", None, 3)
    assert page.passed > 0 and page.after
    for other in ((2, "OMEGA", "key"), (1, "alpha", "key"), (1, "OMEGA", "other")):
        with pytest.raises(ValueError):
            store.history_search(*other, page.after)


def test_outbox_flush(spark, store):
    now = datetime(2024, 1, 20, tzinfo=UTC)
    box = spark.createDataFrame([(i, "pending", now - timedelta(minutes=i)) for i in range(6)], "batch_id int, state string, updated_at timestamp")

    def send(i):
        if i % 2:
            raise OSError("no answer")

    assert sorted((r.batch_id, r.state) for r in store.flush_outbox(box, now, send, 4).collect()) == [(0, "delivered"), (1, "pending"), (2, "delivered"), (3, "pending"), (4, "pending"), (5, "pending")]


def test_maintenance_of_zones(spark, store):
    """The loop keeps the local days of zones up to date with the 15-minute rows, also where events go again."""
    from meterlake.plans.maintenance import Maintenance

    e = T.usage_events(spark, SF).where("ts >= '2024-01-15' AND ts < '2024-01-15 18:00'")
    start, now = datetime(2024, 1, 15, tzinfo=UTC), datetime(2024, 1, 15, 19, tzinfo=UTC)
    store.save_usage_events(e)
    m, ran = Maintenance(store, start, 96, ("Asia/Seoul", "America/New_York")), []
    for n in range(6):
        ran.append(m.tick(now + timedelta(minutes=2 * n)))
    assert "zones" in ran and set(m.rolled.values()) == {store.newest_compaction()} and store.newest_compaction() > 0

    def agrees():
        for zone in m.names:
            got = store.zone_days(zone).groupBy("day").agg(F.sum("event_count").alias("n"), F.sum("input_tokens").alias("t"))
            want = store.events().groupBy(X.bucket_label("ts", zone).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("t"))
            assert rows(got) == rows(want)

    agrees()
    one = store.events().orderBy("ts").limit(3)
    for r in one.collect():
        store.reconcile_usage(r.user_id, r.provider_key, one.where(F.col("dedup_key") == r.dedup_key))
    m.quarter_hours(now, m.dirty(9))
    m.zones(now, [])
    agrees()
