"""Scans in segments against plain loops over whole files, with files cut at any byte."""

import json
import random

import pytest

from meterlake.sources import logs, segments


@pytest.fixture
def tiny_splits(spark):
    """Every file is read by many tasks, some of which begin inside a line."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rollout(rng, n):
    out, total = [], 0
    for _ in range(n):
        kind = rng.random()
        if kind < 0.05:
            out.append({"type": "session_meta", "payload": {"id": f"s{rng.randrange(100)}"}})
        elif kind < 0.1:
            out.append({"type": "turn_context", "payload": {"model": f"m{rng.randrange(100)}"}})
        elif kind < 0.2:
            out.append(None)
        elif kind < 0.3:
            out.append({"type": "other", "text": "é" * rng.randrange(300)})
        else:
            total += rng.choice([0, 0, 7])
            usage = {"input_tokens": rng.randrange(9), "cached_input_tokens": rng.randrange(4), "output_tokens": rng.randrange(3)}
            out.append({"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"total_tokens": total}, "last_token_usage": usage}}})
    return out


def rollout_plain(lines):
    session = model = was = None
    out = []
    for i, x in enumerate(lines):
        if x is None:
            continue
        session = x["payload"]["id"] if x["type"] == "session_meta" else session
        model = x["payload"]["model"] if x["type"] == "turn_context" else model
        if x["type"] == "event_msg":
            total, u = x["payload"]["info"]["total_token_usage"]["total_tokens"], x["payload"]["info"]["last_token_usage"]
            fresh = max(u["input_tokens"] - u["cached_input_tokens"], 0)
            if total != was and fresh + u["output_tokens"] + u["cached_input_tokens"] > 0:
                out.append((i, session, model, fresh, u["output_tokens"], u["cached_input_tokens"]))
            was = total
    return out


def test_rollouts_cut_anywhere(spark, tmp_path, tiny_splits):
    rng, want = random.Random(8), set()
    for name, n in (("a", 400), ("b", 3), ("c", 0), ("d", 250)):
        lines = rollout(rng, n)
        (tmp_path / f"{name}.jsonl").write_text("\n".join("" if x is None else json.dumps(x, ensure_ascii=False) for x in lines) + "\n" * rng.randrange(2))
        want |= {(name, *r) for r in rollout_plain(lines)}
    lines = logs.transcript_lines(spark, str(tmp_path))
    assert lines.select("file", "segment").distinct().count() > 50
    got = logs.rollout_usage(lines).selectExpr("regexp_extract(file, '([a-d]).jsonl', 1)", "line", "session_id", "model", "input_tokens", "output_tokens", "cache_read_tokens")
    assert {tuple(r) for r in got.collect()} == want and any(r[2] is None for r in want) and len(want) > 100


def test_session_lines_cut_anywhere(spark, tmp_path, tiny_splits):
    """Session and model carry forward; a message said again under its id counts once, with what it said last."""
    rng, lines = random.Random(9), []
    for _ in range(300):
        x = {"type": rng.choice(["gemini", "gemini", "user"])}
        if rng.random() < 0.1:
            x["sessionId"] = f"s{rng.randrange(50)}"
        if rng.random() < 0.1:
            x["model"] = f"m{rng.randrange(50)}"
        if x["type"] == "gemini":
            x |= {"id": f"i{rng.randrange(80)}", "timestamp": "2024-01-01T00:00:00Z", "tokens": {"input": rng.randrange(1, 9), "output": rng.randrange(9)}}
        lines.append(x)
    (tmp_path / "named.jsonl").write_text("\n".join(map(json.dumps, lines)))
    document = {"sessionId": "d", "messages": [{"type": "gemini", "model": "dm", "timestamp": "2024-01-01T00:00:00Z", "tokens": {"input": 3}}]}
    (tmp_path / "whole.json").write_text(json.dumps(document, indent=1))
    session, model, last = "named", None, {}
    for i, x in enumerate(lines):
        session, model = x.get("sessionId", session), x.get("model", model)
        if x["type"] == "gemini" and model:
            last[x["id"]] = (i, session, model, x["tokens"]["input"], x["tokens"]["output"])
    got = logs.session_usage(logs.session_files(spark, str(tmp_path)), logs.session_lines(spark, str(tmp_path)))
    got = {tuple(r) for r in got.select("line", "session_id", "model", "input_tokens", "output_tokens").collect()}
    assert got == set(last.values()) | {(0, "d", "dm", 3, 0)} and len(last) > 50


def test_other_files_cut_anywhere(spark, tmp_path, tiny_splits):
    """Plain transcripts, the assistant's lines, captured generations and chat files keep their line numbers and turns."""
    rng = random.Random(10)
    text = [rng.choice(["user: hi", "A: there", "more", "  [Tool call] mcp__a__b(c)", "[Tool result] x", "", "é" * 90]) for _ in range(400)]
    (tmp_path / "t.txt").write_text("\n".join(text))
    whole = spark.createDataFrame([("t", i, x) for i, x in enumerate(text)], "file string, line int, value string")
    cut = segments.lines_below(spark, str(tmp_path), "*.txt")
    for f in (logs.plain_turns, logs.plain_tools):
        rows = [sorted(tuple(r) for r in f(x).drop("file").collect()) for x in (whole, cut)]
        assert rows[0] == rows[1] and len(rows[0]) > 20
    counts = {"input_tokens": 4, "output_tokens": 1}
    said = [rng.choice([{"type": "user"}, {"type": "assistant", "sessionId": "s", "message": {"model": f"m{i}", "usage": counts}}, {"type": "assistant", "usageMetadata": {"promptTokenCount": 3}}, {"generationId": f"g{i // 9}", "tsMs": i, "inputTokens": i}, None]) for i in range(300)]
    values = ["" if x is None else json.dumps(x) for x in said]
    (tmp_path / "u.jsonl").write_text("\n".join(values))
    whole = spark.createDataFrame([("u", i, x) for i, x in enumerate(values)], "file string, line long, value string")
    cut = logs.transcript_lines(spark, str(tmp_path)).drop("modified")
    for f, n in ((logs.assistant_usage, 40), (logs.chat_usage, 40), (logs.captured_usage, 20)):
        rows = [sorted((tuple(r) for r in f(x).drop("file").collect()), key=repr) for x in (whole, cut)]
        assert [[v for v in r if v != "unknown-u"] for r in rows[0]] == [[v for v in r if v != "unknown-u"] for r in rows[1]] and len(rows[0]) > n, f


def test_carried_over_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENT_BITS", 3)
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, None, f"v{i}"])) for i in rng.sample(range(5000), 600)]
    want, state = set(), {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        so_far, n = state.get(k, (None, 0))
        now = (v or so_far, n + (v is not None))
        want.add((k, i, now[0], so_far, now[1]))
        state[k] = now
    got = segments.carried(spark.createDataFrame(rows, "k int, i long, v string"), "k", "i", ("v",), {"was": "v"}, {"n": "v"})
    assert {tuple(r) for r in got.select("k", "i", "v", "was", "n").collect()} == want
