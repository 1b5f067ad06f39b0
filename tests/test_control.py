"""Transcript readers, file cursors, disjoint prices, rollouts and the scheduler on small inputs."""

import json
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import functions as F

from meterlake.operators import deploy, pricing, repair
from meterlake.plans import jobs
from meterlake.sources import logs

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def counts(rows):
    return sorted((r.session_id, r.model, r.input_tokens, r.output_tokens, r.cache_read_tokens) for r in rows)


def test_session_documents(spark, tmp_path):
    message = {"type": "gemini", "model": "m", "timestamp": "2024-01-01T00:00:00Z", "tokens": {"input": 100.9, "output": 20, "cached": 30, "thoughts": 3, "total": 123}}
    (tmp_path / "a.json").write_text(json.dumps({"sessionId": "s1", "messages": [message, {"type": "user"}, message | {"model": " "}]}))
    (tmp_path / "b.json").write_text(json.dumps({"sessionId": "s2", "stats": {"models": {"p": {"tokens": {"prompt": 100, "candidates": 20, "cached": 30, "thoughts": 3}}, "z": {"tokens": {"prompt": 0}}}}}))
    (tmp_path / "c.json").write_text(json.dumps({"session_id": "s3", "stats": {"input_tokens": 5, "total_tokens": 9}}))
    (tmp_path / "d.json").write_text("not json")
    rows = logs.session_usage(logs.session_files(spark, str(tmp_path))).collect()
    assert counts(rows) == [("s1", "m", 70, 23, 30), ("s2", "p", 70, 23, 30), ("s3", "unknown", 5, 4, 0)]


def test_session_lines(spark, tmp_path):
    say = lambda i, n, **more: {"type": "gemini", "id": i, "tokens": {"input": n, "output": 1}} | more
    lines = [{"sessionId": "s"}, say("a", 1), {"model": "m"}, say("b", 2), say("b", 3), say(None, 4), say(None, 4, model="k"), {"stats": {"input": 8, "cached": 3}}]
    (tmp_path / "x.jsonl").write_text("\n".join(["broken", *map(json.dumps, lines)]))
    rows = logs.session_usage(logs.session_files(spark, str(tmp_path))).collect()
    assert counts(rows) == [("s", "k", 4, 1, 0), ("s", "k", 5, 0, 3), ("s", "m", 3, 1, 0), ("s", "m", 4, 1, 0)]
    assert all(r.ts is not None for r in rows)


def test_chat_lines(spark):
    line = lambda **u: json.dumps({"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "usageMetadata": u})
    rows = [("/h/projects/pr/chats/c.jsonl", 0, line(promptTokenCount=5, candidatesTokenCount=0, totalTokenCount=9)), ("/tmp/c.jsonl", 0, line(promptTokenCount=5, candidatesTokenCount=2, thoughtsTokenCount=1, totalTokenCount=10)), ("/tmp/c.jsonl", 1, line(promptTokenCount=0)), ("/tmp/c.jsonl", 2, "{}")]
    out = logs.chat_usage(spark.createDataFrame(rows, "file string, line int, value string")).collect()
    assert counts(out) == [("pr-c", "unknown", 5, 4, 0), ("unknown-c", "unknown", 5, 5, 0)]


def test_captured(spark):
    line = lambda g, n: json.dumps({"generationId": g, "sessionId": "s", "model": "m", "tsMs": 1000, "inputTokens": n, "outputTokens": 0, "cacheReadTokens": 0, "cacheCreationTokens": 0})
    rows = [("f", 0, line("a", 1)), ("f", 1, line("a", 2)), ("f", 2, line("b", 0)), ("f", 3, line("b", 5)), ("g", 0, line("a", 7)), ("g", 1, "{")]
    out = logs.captured_usage(spark.createDataFrame(rows, "file string, line int, value string")).collect()
    assert sorted(r.input_tokens for r in out) == [1, 7]


def test_transcript_paths(spark):
    base = "/h/agent-transcripts"
    paths = [f"{base}/s1.jsonl", f"{base}/s1/transcript.jsonl", f"{base}/s1/subagents/a.jsonl", f"{base}/s1/subagents/a/subagents/b/transcript.jsonl"]
    out = spark.createDataFrame([(p,) for p in paths], "file string").select("file", *logs.transcript_agent()).collect()
    assert [tuple(r)[1:] for r in out] == [("s1", None, None, None), ("s1", None, None, None), ("s1", "a", "s1", 1), ("s1", "b", "a", 2)]


def test_cursor(spark):
    prefix = spark.range(1).select(logs.prefix_hash(F.array(F.lit("1"), F.lit("2")), F.lit(2)).alias("h")).first().h
    files = [("same", 1, 3, "1\n2\n"), ("more", 2, 9, "1\n2\n3\n"), ("other", 2, 9, "x\n2\n3"), ("new", 1, 1, "n")]
    cursors = [("same", 1, 3, 2, prefix), ("more", 1, 5, 2, prefix), ("other", 1, 5, 2, prefix)]
    out = logs.unsent(spark.createDataFrame(files, "file string, modified long, size long, value string"), spark.createDataFrame(cursors, "file string, modified long, size long, sent int, prefix string"))
    assert sorted((r.file, r.value) for r in out.collect()) == [("more", "3"), ("new", "n"), ("other", "2"), ("other", "3"), ("other", "x")]


def test_prices_do_not_overlap(spark):
    at = lambda d: None if d is None else f"2024-01-{d:02}"
    revisions = [(1, "m", 1, None, 1.0), (2, "m", 5, 8, 2.0), (3, "m", 5, 6, 3.0), (4, "m", 20, None, 4.0), (5, "n", 3, 4, 5.0)]
    r = spark.createDataFrame([(i, m, at(a), at(b), p) for i, m, a, b, p in revisions], "id int, model_id string, e string, v string, input double")
    r = r.select("id", "model_id", F.col("e").cast("timestamp").alias("effective_at"), F.col("v").cast("timestamp").alias("valid_until"), "input")
    events = spark.createDataFrame([(f"{m}{d}", m, d) for m in ("m", "n", None) for d in range(1, 29)], "k string, model string, d int").select("k", "model", "d", F.make_timestamp(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)).alias("ts"))
    rows = pricing.as_of(events, r).collect()
    assert len(rows) == 84
    for x in rows:
        fits = [(a, i) for i, m, a, b, _ in revisions if m == x.model and a <= x.d and (b is None or x.d < b)]
        assert x.revision_id == (max(fits)[1] if fits else None)


def test_counters_below_zero(spark):
    df = lambda *r: spark.createDataFrame([(x,) for x in r], "state string")
    out = repair.counters(df("a").withColumn("n", F.lit(1)), df("a", "b"), df("c"), ["state"]).collect()
    assert sorted((r.state, r.n, r.sound) for r in out) == [("b", -1, False), ("c", 1, True)]


def test_decisions(spark):
    rows = [("canary", 0, 1, 0, 60), ("canary", 20, 2, 0, 30), ("canary", 20, 1, 0, 30), ("canary", 20, 2, 0, 29), ("expand", 10, 5, 0, 60), ("expand", 10, 10, 2, 60), ("expand", 10, 5, 1, 60), ("preflight", 10, 9, 1, 99), ("canary", 9, 0, 0, 99)]
    df = spark.createDataFrame(rows, "phase string, eligible long, attempted long, failed long, age int").withColumn("phase_started", F.lit("2024-01-01").cast("timestamp") - F.make_dt_interval(mins=F.col("age")))
    got = [(r.action, r.next_phase, r.percent) for r in deploy.decided(df, "2024-01-01").collect()]
    go, hold, back = ("advance", "expand", 50), ("hold", None, None), ("rollback", None, None)
    assert got == [go, go, hold, hold, ("advance", "active", 100), back, back, hold, hold]


def test_next_task():
    c, ago = jobs.Candidate, lambda s: T0 - timedelta(seconds=s)
    assert jobs.next_task([], T0) is None and jobs.next_task([c("zones", due=False)], T0) is None
    assert jobs.next_task([c("zones", last_started=ago(59)), c("pricing_repair", last_started=ago(10))], T0) == "pricing_repair"
    assert jobs.next_task([c("zones", eligible_since=ago(120), last_started=ago(90)), c("quarter_hours")], T0) == "zones"
    assert jobs.next_task([c("zones", eligible_since=ago(999)), c("validation")], T0) == "validation"
    assert jobs.next_task([c("zones"), c("quarter_hours")], T0) == "quarter_hours"


def test_limits_and_progress():
    assert jobs.next_limit(100, 100, 1000, False, 25, 500) == 125 and jobs.next_limit(100, 99, 1000, False, 25, 500) == 100
    assert jobs.next_limit(40, 40, 10_000, False, 25, 500) == 25 and jobs.next_limit(450, 450, 1, False, 25, 500) == 500
    q = lambda n: T0 + timedelta(minutes=15 * n)
    assert jobs.progress(q(0), q(10), q(4), [q(1), q(1), q(5), q(20)], 2) == jobs.Progress(40.0, 4, 10, 7, 4)
    assert jobs.progress(q(0), q(0), None, []).remaining == 0 and jobs.progress(q(0), q(2), None, []).eta_minutes is None


def test_prewarm():
    chunks = jobs.prewarm(date(2024, 3, 20), "America/New_York")
    for unit, least in (("day", 400), ("hour", 32)):
        spans = sorted(c[1:] for c in chunks if c[0] == unit)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert spans[-1][1] - spans[0][0] in (timedelta(days=least), timedelta(days=least, hours=-1))


def test_cutover():
    now, c = T0, jobs.Cutover()
    c, check = jobs.observe(c, now, True)
    assert check
    c = jobs.validated(c, now, True)
    looks = 0
    while True:
        now += timedelta(seconds=90)  # a look counts for a minute at most
        c, check = jobs.observe(c, now, True)
        looks += 1
        if check:
            break
    assert (c.state, looks) == ("observing", 60)
    c = jobs.validated(c, now, True)
    assert c.state == "active" and jobs.layer("auto", c, jobs.Cutover()) == "rollup" and jobs.layer("auto", c, c) == "zones"
    assert not jobs.observe(c, now + timedelta(hours=5), True)[1] and jobs.observe(c, now + timedelta(hours=6), True)[1]
    for state in ("active", "active", "fallback"):
        c, _ = jobs.observe(c, now, False)
        assert c.state == state
    assert jobs.layer("auto", c, c) == "raw"
    assert jobs.validated(jobs.Cutover("active"), now, False, mismatch=True).state == "fallback"
