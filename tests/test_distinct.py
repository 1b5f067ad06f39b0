"""Distinct counts that merge, against plain sets."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake.functions import exprs as X
from meterlake.plans import distinct, rollup
from meterlake.sources import tables as T

SF = "/root/testdata/sf0.01"
KIND = "ts timestamp, provider_key string, session_id string, user_id long, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, cost_usd decimal(18,8), cost_status string, event_count long"
PROVIDER = {"provider_key": "provider_key"}


def events(spark, n, sessions, seed=5):
    rng, at = random.Random(seed), datetime(2024, 3, 1, tzinfo=UTC)
    rows = []
    for _ in range(n):
        session = rng.choice([None, "", *[f"s{rng.randrange(sessions)}" for _ in range(8)]])
        rows.append((at + timedelta(minutes=rng.randrange(4000)), rng.choice(["a", "b", None]), session, rng.choice([None, *range(30)]), 1, 2, 3, 4, None, rng.choice(["priced", "unpriced"]), 1))
    return rows, spark.createDataFrame(rows, KIND)


def test_numbers_have_no_gaps_and_stay(spark):
    rows, e = events(spark, 3000, 700)
    first = distinct.numbered(e.where("minute(ts) < 30"))
    rest = distinct.numbered(e, first)
    got = {(r.of, r.value): r.number for r in first.unionByName(rest).collect()}
    for of, want in (("sessions", {r[2] for r in rows if r[2]}), ("active_users", {str(r[3]) for r in rows if r[3] is not None})):
        assert {v for k, v in got if k == of} == want
        assert sorted(n for (k, _), n in got.items() if k == of) == list(range(1, len(want) + 1))
    assert all(got[r.of, r.value] == r.number for r in first.collect())
    assert distinct.numbered(e, first.unionByName(rest)).count() == 0


@pytest.mark.parametrize("few", [1024, 3, 0])
def test_sets_of_any_cells_unite(spark, monkeypatch, few):
    """Arrays and bitmaps, several chunks, null keys, values without a number."""
    monkeypatch.setattr(distinct, "FEW", few)
    rows, e = events(spark, 2500, 300)
    numbers = distinct.numbered(e.where("minute(ts) < 50")).withColumn("number", F.col("number") * 997)  # over many chunks
    cell = {"bucket": X.bucket_start("ts"), **PROVIDER}
    cells, sets = distinct.totals(e, **cell), distinct.sets(e, numbers, **cell)
    if few:
        assert sets.where("size(few) > " + str(few)).isEmpty()
    else:
        assert sets.where("few IS NOT NULL").isEmpty()
    got = {r.provider_key: r for r in distinct.measured(cells, sets, distinct.unnumbered(e, numbers, **PROVIDER), **PROVIDER).collect()}
    assert len(got) == 3
    for p, r in got.items():
        mine = [x for x in rows if x[1] == p]
        assert (r.sessions, r.active_users) == (len({x[2] for x in mine if x[2]}), len({x[3] for x in mine if x[3] is not None}))
        assert (r.input_tokens, r.priced_events) == (len(mine), sum(x[9] == "priced" for x in mine))
    whole = distinct.measured(cells, sets, distinct.unnumbered(e, numbers)).collect()
    assert [(r.sessions, r.active_users) for r in whole] == [(len({x[2] for x in rows if x[2]}), len({x[3] for x in rows if x[3] is not None}))]


def test_nothing_counts_nothing(spark):
    _, e = events(spark, 5, 2)
    none = e.where("false")
    numbers = distinct.numbered(none)
    assert numbers.count() == 0 and distinct.sets(none, numbers, **PROVIDER).count() == 0
    r = distinct.measured(distinct.totals(none, **PROVIDER), distinct.sets(none, numbers, **PROVIDER)).first()
    assert (r.sessions, r.active_users, r.input_tokens, r.cost) == (0, 0, 0, 0.0)
    lone = e.withColumn("session_id", F.lit("")).withColumn("user_id", F.lit(None).cast("long"))
    got = distinct.measured(distinct.totals(lone, **PROVIDER), distinct.sets(lone, distinct.numbered(lone), **PROVIDER), **PROVIDER).collect()
    assert got and all((r.sessions, r.active_users) == (0, 0) for r in got)


def test_fewer_rows_than_with_sessions(spark):
    """Days by provider: one row and a set or two for each, instead of a row for each session and all else that it has."""
    e = T.usage_events(spark, SF)
    day = {"day": X.bucket_label("ts", "UTC"), **PROVIDER}
    short = distinct.totals(e, **day).count() + distinct.sets(e, distinct.numbered(e), **day).count()
    assert 10 * short < rollup.local_rollup(rollup.compact(e), "UTC").count()
