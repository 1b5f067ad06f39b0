"""Parsers, calendar arithmetic, the rollup planner and streaming on small inputs."""

import json
from datetime import UTC, date, datetime, timedelta

from meterlake.functions import exprs as X
from meterlake.functions import timeutil
from meterlake.plans import rollup
from meterlake.sources import logs, segments
from meterlake.streaming import usage as stream


def wire(key, ts="2024-01-01T00:01:00Z", **more):
    return json.dumps({"dedupKey": key, "providerKey": "p", "ts": ts, "inputTokens": 5, "outputTokens": 1, "cacheReadTokens": 0, "cacheCreationTokens": 2} | more)


def test_otlp(spark):
    attr = lambda k, **v: {"key": k, "value": v}
    record = lambda t, name, *a: {"timeUnixNano": t, "eventName": name, "attributes": list(a)}
    usage = [attr("input_tokens", intValue="5000"), attr("cache_read_tokens", intValue="2000"), attr("output_tokens", intValue="7"), attr("prompt", stringValue="x")]
    payload = {"resourceLogs": [{"resource": {"attributes": [attr("service.name", stringValue="codex-cli")]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [record("1704067200000000000", "x.api_request", *usage), record("0", "x.api_request", *usage), record("1704067200000000000", "other")]}]}]}
    records = logs.otlp_records(spark.createDataFrame([(json.dumps(payload),)], "payload string"))
    assert records.count() == 2 and "prompt" not in records.collect()[0].attributes
    rows = logs.requests(records).collect()
    assert [(r.input_tokens, r.cache_read_tokens, r.output_tokens) for r in rows] == [(3000, 2000, 7)]


def test_wire(spark):
    lines = [wire("a"), wire(""), wire("b", ts="never"), wire("c", inputTokens=-1), wire("d", cacheCreation1hTokens=3), "not json"]
    rows = logs.wire_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.error for r in rows] == [None, "dedupKey", "ts", "inputTokens", "cacheCreation1hTokens", "dedupKey"]


def test_transcripts(spark, tmp_path):
    a = [{"type": "session_meta", "payload": {"id": "s1"}}, {"type": "turn_context", "payload": {"model": "m"}}]
    count = lambda n: {"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": n}, "last_token_usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 3}}}}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.jsonl").write_text("\n".join(map(json.dumps, [*a, count(13), count(13), count(26)])))
    lines = logs.transcript_lines(spark, str(tmp_path))
    assert sorted(r.line for r in segments.numbered(lines).collect()) == [0, 1, 2, 3, 4]
    rows = logs.rollout_usage(lines).collect()
    assert [(r.session_id, r.model, r.input_tokens, r.cache_read_tokens) for r in rows] == [("s1", "m", 6, 4)] * 2


def test_calendar():
    assert timeutil.first_instant(date(2024, 9, 8), "America/Santiago") == datetime(2024, 9, 8, 4, tzinfo=UTC)
    assert timeutil.add_months(date(2024, 1, 31), 1) == date(2024, 2, 29) and timeutil.week_start(date(2024, 1, 3)) == date(2023, 12, 31)
    p = timeutil.preset("7d", datetime(2024, 1, 10, 12, tzinfo=UTC), "UTC")
    assert p.end - p.start == timedelta(days=7) and timeutil.previous(p).end == p.start


def test_planner():
    at = lambda m: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=m)
    assert rollup.plan(at(7), at(100), at(90), []) == rollup.Plan(((at(7), at(15)), (at(90), at(100))), (at(15), at(90)))
    assert rollup.plan(at(0), at(60), at(60), [at(30)]) == rollup.Plan(((at(30), at(60)),), (at(0), at(30)))
    assert rollup.plan(at(0), at(60), at(0), []).rollup is None
    assert len(rollup.next_buckets(at(0), [at(-30), at(-15)], at(120), 4)) == 4


def test_cohort(spark):
    from pyspark.sql import functions as F

    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h % 100

    texts = ["", "seed:abc", "é:日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.fnv1a_percent(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == list(map(fnv, texts))


def test_stream_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join([wire("a"), wire("a"), wire("b", ts="2024-01-01T00:20:00Z")]))
    run = lambda n: stream.raw_sink(stream.wire_stream(spark, str(source)), str(tmp_path / "raw"), str(tmp_path / "dirty"), str(tmp_path / n)).awaitTermination(60)
    run("c1")
    (source / "2.json").write_text("\n".join([wire("a"), wire("c")]))
    run("c1")
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert sorted(r.dedupKey for r in raw.collect()) == ["a", "b", "c"]
    assert spark.read.parquet(str(tmp_path / "dirty")).select("bucket").distinct().count() == 2


def test_stream_keeps_events_hours_late(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: stream.raw_sink(stream.wire_stream(spark, str(source)), str(tmp_path / "raw"), str(tmp_path / "dirty"), str(tmp_path / "c")).awaitTermination(60)
    for k, lines in enumerate([[wire("a", ts="2024-01-01T12:00:00Z")], [wire("b", ts="2024-01-01T12:01:00Z")], [wire("late", ts="2024-01-01T06:00:00Z"), wire("late", ts="2024-01-01T06:00:00Z"), wire("a", ts="2024-01-01T12:00:00Z")]]):
        (source / f"{k}.json").write_text("\n".join(lines))
        run()
    assert sorted(r.dedupKey for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == ["a", "b", "late"]
    assert {r.bucket.hour for r in spark.read.parquet(str(tmp_path / "dirty")).collect()} == {6, 12}


def test_wire_bodies(spark):
    from meterlake.sources import wire as W

    bodies = lambda *x: spark.createDataFrame([(b,) for b in x], "value string")
    sound = {"dedupKey": "a" * 64, "providerKey": "p", "ts": "2024-01-01T00:00:00Z", "activityKind": "mcp", "itemKey": "i", "displayName": "d", "outcome": "success", "detection": "explicit"}
    rows = W.activity(bodies(json.dumps([sound, sound | {"more": 1}, sound | {"host": "h" * 256}]), "{}", "[]", None, json.dumps([sound] * 501))).collect()
    errors = [r.error for r in rows]
    assert errors[:3] == [None, "unknown", "host"] and errors[3:5] == ["body"] * 2 and set(errors[5:]) == {"length"} and len(errors) == 506
    rows = W.inventory(bodies(json.dumps({"fingerprint": "b" * 64, "observedAt": "2024-01-01T00:00:00Z", "items": [{"kind": "plugin", "itemKey": "x", "displayName": "x", "sourceProvider": "p", "enabled": True}, {"kind": "plugin", "itemKey": "x", "displayName": "x", "sourceProvider": "p"}]}), json.dumps({"fingerprint": "b"}))).collect()
    assert [r.error for r in rows] == [None, "item.enabled", "fingerprint"]
    turn = {"dedupKey": "k", "providerKey": "p", "turnRole": "user", "ts": "2024-01-01T00:00:00Z", "text": "t"}
    rows = W.prompts(bodies(json.dumps([turn, turn | {"text": ""}, turn | {"agent": {"id": "a", "depth": 33}}, turn | {"agent": {"id": "a", "depth": 2}}, turn | {"agent": {}}]))).collect()
    assert [(r.error, r.agent_depth) for r in rows] == [(None, None), ("text", None), ("agent.depth", 33), (None, 2), ("agent.id", None)]


def test_log_records_keep_microseconds_and_drop_text(spark):
    attribute = lambda k, v: {"key": k, "value": {"stringValue": v}}
    record = {"timeUnixNano": "1704838913938320999", "attributes": [attribute(k, "x") for k in ("model", *logs.DENIED)]}
    payload = {"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [record]}]}]}
    (row,) = logs.otlp_records(spark.createDataFrame([(json.dumps(payload),)], "payload string")).collect()
    assert row.ts.microsecond == 938320 and set(row.attributes) == {"model"}


def test_previous_periods():
    at = lambda *x: datetime(2024, *x, tzinfo=UTC)
    p = timeutil.preset("month", at(3, 15, 12), "UTC")
    assert timeutil.previous(p, "month", "UTC") == timeutil.Period(at(2, 1), at(3, 1))
    assert timeutil.previous(timeutil.preset("quarter", at(5, 1), "UTC"), "quarter", "UTC").start == at(1, 1)
    now, before = timeutil.insight_pair("month", "UTC", at(3, 30, 12))
    assert now.start == at(3, 1) and before == timeutil.Period(at(2, 1), at(3, 1))  # a shorter month ends at its end
    assert timeutil.anchor(at(3, 30, 12, 19, 59)) == at(3, 30, 12, 10)


def test_plain_transcripts(spark):
    text = "lost\nuser: a\nb\nA: c\n[Tool call] mcp__docs__search__all(q)\n  [Tool result] hidden\nd\n[Tool call] other\nuser:\nA: "
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, line int, value string")
    assert sorted((r.turn, r.role, r.text) for r in logs.plain_turns(lines).collect()) == [(1, "user", "a\nb"), (2, "assistant", "c\nd")]
    assert [(r.call, r.item_key) for r in logs.plain_tools(lines).collect()] == [(0, "docs.search.all")]
