"""Parsers of nested log exports, wire events, price lists and transcripts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..schemas import OTLP_LOGS, USAGE_WIRE
from .segments import carried, lines_below, numbered

#: Attributes that may hold free text and are never kept.
DENIED = ("prompt", "prompt_text", "user_prompt", "body", "Body", "latest_user_message", "message", "content", "text", "tool_result")
#: Resource attributes that name the machine, the first that is there holds; a deployment may put its own before.
HOSTS = ("host.name",)


def attributes(column: str) -> Column:
    """Key and value pairs as a map of text; of repeated keys the last counts."""
    v = lambda kv: F.coalesce(kv["value"]["stringValue"], kv["value"]["intValue"], kv["value"]["doubleValue"].cast("string"), kv["value"]["boolValue"].cast("string"))
    pairs = F.coalesce(F.col(column), F.array())
    later = F.filter(pairs, lambda kv, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda o: o["key"] == kv["key"]))
    return F.map_from_entries(F.transform(later, lambda kv: F.struct(kv["key"].alias("key"), v(kv).alias("value"))))


def without_text(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, _: ~k.isin(*DENIED))


def group_host(resource: str, order: str, keys: tuple[str, ...] = HOSTS) -> Column:
    """An aggregate: the first record's machine, in order, of those that name one."""
    host = X.clean_host(F.coalesce(*[F.element_at(resource, k) for k in keys]))
    return F.min_by(host, F.when(host.isNotNull(), F.col(order)))


def is_request(name: Column) -> Column:
    return (name == "api_request") | F.endswith(name, F.lit(".api_request"))


def otlp_records(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A row per log record with a positive time: resource and record attributes, denied keys left out."""
    r = payloads.select(F.from_json(column, OTLP_LOGS.replace("\n", "")).alias("p")).select(F.explode("p.resourceLogs").alias("r"))
    s = r.select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeLogs").alias("s"))
    x = s.select("ra", F.col("s.scope.name").alias("scope"), F.explode("s.logRecords").alias("l")).select("ra", "scope", "l.*")
    nanos = F.coalesce(F.nullif(F.col("timeUnixNano").try_cast("long"), F.lit(0)), F.col("observedTimeUnixNano").try_cast("long"))
    safe = lambda c: without_text(attributes(c))
    return x.select("scope", "eventName", F.timestamp_micros(F.call_function("div", nanos, F.lit(1000))).alias("ts"), nanos.alias("nanos"), safe("ra").alias("resource"), safe("attributes").alias("attributes")).where("nanos > 0")


def requests(records: DataFrame, hosts: tuple[str, ...] = HOSTS) -> DataFrame:
    """Request events as usage: input of providers that include cached tokens is corrected, empty usage goes."""
    a = lambda k: F.element_at("attributes", k)
    n = lambda k: F.greatest(F.coalesce(a(k).try_cast("long"), F.lit(0)), F.lit(0))
    name = F.coalesce("eventName", a("event.name"))
    rows = records.where(is_request(name))
    subset = F.coalesce(F.element_at("resource", "service.name"), F.lit("")).contains("codex")
    cached = n("cache_read_tokens") + n("cached_token_count")
    inp = n("input_tokens") + n("input_token_count")
    out = rows.select("ts", F.element_at("resource", "service.name").alias("service"), X.clean_host(F.coalesce(*[F.element_at("resource", k) for k in hosts])).alias("host"), F.coalesce(a("session.id"), a("conversation.id")).alias("session_id"), a("model").alias("model"), F.when(subset, F.greatest(inp - cached, F.lit(0))).otherwise(inp).alias("input_tokens"), (n("output_tokens") + n("output_token_count")).alias("output_tokens"), cached.alias("cache_read_tokens"), n("cache_creation_tokens").alias("cache_creation_tokens"))
    return out.where(X.total_tokens() > 0)


def wire_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Wire events with `error` (null if sound); nothing is dropped, bad rows are for quarantine."""
    e = lines.select(F.from_json(column, USAGE_WIRE.replace("\n", ""), {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    t = F.expr("try_to_timestamp(ts)")
    count = ["inputTokens", "outputTokens", "cacheReadTokens", "cacheCreationTokens"]
    bad = F.when(F.coalesce(F.length("dedupKey"), F.lit(0)) == 0, "dedupKey").when(F.coalesce(F.length("providerKey"), F.lit(0)) == 0, "providerKey").when(t.isNull(), "ts")
    for c in count:
        bad = bad.when(F.col(c).isNull() | (F.col(c) < 0), c)
    bad = bad.when(F.coalesce("cacheCreation1hTokens", F.lit(0)) > F.col("cacheCreationTokens"), "cacheCreation1hTokens").when(F.col("costUsd") < 0, "costUsd")
    return e.withColumn("ts", t).withColumn("error", bad)


def price_list(spark: SparkSession, text: DataFrame, column: str = "value", *more: Column) -> DataFrame:
    """A JSON map of prices per token to a table of prices per million; entries without input or output price are passed over."""
    m = text.select(*more, F.explode(F.from_json(column, "map<string,struct<input_cost_per_token:double,output_cost_per_token:double,cache_read_input_token_cost:double>>")).alias("model_id", "p"))
    kept = [c for c in m.columns if c not in ("model_id", "p")]
    return m.where("p.input_cost_per_token IS NOT NULL AND p.output_cost_per_token IS NOT NULL").select("model_id", *kept, *[F.round(F.col(f"p.{a}") * 1e6, 8).alias(b) for a, b in (("input_cost_per_token", "input"), ("output_cost_per_token", "output"), ("cache_read_input_token_cost", "cache_read"))])


def price_snapshots(files: DataFrame, column: str = "value") -> DataFrame:
    """Price files with the time of their commit (committed_at) to a row a model and file; a file is read by its own."""
    return price_list(files.sparkSession, files, column, F.col("committed_at").alias("observed_at"))


def discovered(files: DataFrame, root: str, extensions: tuple[str, ...], depth: int = 12) -> DataFrame:
    """Files (column file) below a root that have one of the extensions and are at most so many folders deep."""
    start = f"{root.rstrip('/')}/"
    below = F.startswith(F.col("file"), F.lit(start)) & (F.size(F.split(F.substr("file", F.lit(len(start) + 1)), "/")) - 1 <= depth)
    named = F.lit(False)
    for x in extensions:
        named |= F.endswith(F.col("file"), F.lit(x))
    return files.where(below & named)


def is_chat_file(column: str, root: str) -> Column:
    """Exactly root/projects/<one folder>/chats/<name>.jsonl."""
    return F.rlike(F.col(column), F.lit("^" + re.escape(root.rstrip("/")) + r"/projects/[^/]+/chats/[^/]+\.jsonl$"))


def transcript_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of transcript files below a folder, read by byte ranges; see segments.lines_below."""
    return lines_below(spark, path, pattern)


def _places(lines: DataFrame) -> list[str]:
    return [c for c in ("file", "line", "segment", "place") if c in lines.columns]


def _numbered(rows: DataFrame) -> DataFrame:
    return rows if "line" in rows.columns else numbered(rows)


def assistant_usage(lines: DataFrame) -> DataFrame:
    """Usage of the assistant's lines; lines without any tokens go."""
    g = lambda p: F.get_json_object("value", p)
    n = lambda p: F.coalesce(g(f"$.message.usage.{p}").try_cast("long"), F.lit(0))
    hour = F.coalesce(g("$.message.usage.cache_creation.ephemeral_1h_input_tokens").try_cast("long"), F.lit(0))
    kept = _places(lines)
    out = lines.select(*kept, (g("$.type") == "assistant").alias("said"), g("$.sessionId").alias("session_id"), g("$.message.model").alias("model"), g("$.requestId").alias("request_id"), F.expr("try_to_timestamp(get_json_object(value, '$.timestamp'))").alias("ts"), n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"), n("cache_read_input_tokens").alias("cache_read_tokens"), n("cache_creation_input_tokens").alias("cache_creation_tokens"), hour.alias("one_hour_tokens"))
    return _numbered(out).where(F.col("said") & (X.total_tokens() > 0)).drop("said").select("file", "line", *[c for c in out.columns if c not in (*kept, "said")])


def rollout_usage(lines: DataFrame) -> DataFrame:
    """Rollout files: session and model carry forward, a cumulative total said again is passed over, cached input comes off."""
    g = lambda p: F.get_json_object("value", p)
    base = "$.payload.info.last_token_usage"
    n = lambda p: F.coalesce(g(f"{base}.{p}").try_cast("long"), F.lit(0))
    cached = n("cached_input_tokens")
    total = F.when(g("$.payload.type") == "token_count", g("$.payload.info.total_token_usage.total_tokens").try_cast("long"))
    kept = _places(lines)
    x = lines.select(*kept, F.when(g("$.type") == "session_meta", g("$.payload.id")).alias("session_id"), F.when(g("$.type") == "turn_context", g("$.payload.model")).alias("model"), total.alias("total"), F.expr("try_to_timestamp(get_json_object(value, '$.timestamp'))").alias("ts"), F.greatest(n("input_tokens") - cached, F.lit(0)).alias("input_tokens"), n("output_tokens").alias("output_tokens"), cached.alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"))
    x = carried(x, last=("session_id", "model"), before={"was": "total"}).where(F.col("total").isNotNull() & ~F.col("total").eqNullSafe(F.col("was")))
    return x.where(X.total_tokens() > 0).select("file", "line", "session_id", "model", "ts", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def path_part(column: str, pattern: str) -> Column:
    """The first group of a pattern in a path, null if there is none."""
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))


def file_stem(column: str = "file") -> Column:
    return path_part(column, r"([^/]+?)(?:\.[^./]*)?$")


def _moment(*texts: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(t) for t in texts])


def with_missing_total(inp: Column, out: Column, cached: Column, extra: Column, total: Column) -> Column:
    """Output with reasoning and with what a stated total has beyond the known counts."""
    return out + extra + F.greatest(total - (inp + out + cached + extra), F.lit(0))


#: Names under which session files give a count, the first that is there holds.
TOKEN_NAMES = {
    "input": ("input", "prompt", "input_tokens", "prompt_tokens"),
    "output": ("output", "candidates", "output_tokens", "candidates_tokens"),
    "cached": ("cached", "cached_tokens"),
    "thoughts": ("thoughts", "reasoning", "thoughts_tokens", "reasoning_tokens"),
    "tool": ("tool", "tool_tokens"),
    "total": ("total", "total_tokens"),
}


def _session_tokens(tokens: Column, model: Column, direct: bool) -> Column:
    """Model and counts of a JSON object of tokens; null without an object, a model or any token.  Fractions are cut off,
    negatives are zero.  Input loses its cached part: in totals always, in messages if their total shows that it is in it.

    What is used often is bound once, as a plan holds each use of an expression."""
    def number(said: Column, name: str) -> Column:
        found = F.coalesce(*[F.get_json_object(said, f"$.{k}").try_cast("double") for k in TOKEN_NAMES[name]])
        n = F.floor(F.greatest(found, F.lit(0.0))).cast("long")
        return (n if name == "total" else F.coalesce(n, F.lit(0))).alias(name)

    def usage(n: Column) -> Column:
        whole = n["input"] + n["output"] + n["thoughts"] + n["tool"]
        overlap = ((n["cached"] > 0) & n["total"].eqNullSafe(whole)) if direct else F.lit(True)
        inp = F.when(overlap, F.greatest(n["input"] - n["cached"], F.lit(0))).otherwise(n["input"]) + n["tool"]
        total = F.coalesce(n["total"], F.lit(0).cast("long"))
        return X.once(inp, lambda inp: F.struct(n["name"].alias("model"), inp.alias("input_tokens"), with_missing_total(inp, n["output"], n["cached"], n["thoughts"], total).alias("output_tokens"), n["cached"].alias("cache_read_tokens")))

    counts = X.once(tokens, lambda said: F.when(F.startswith(F.trim(said), F.lit("{")), F.struct(F.when(F.trim(model) != "", model).alias("name"), *[number(said, k) for k in TOKEN_NAMES])))
    some = lambda u: F.when(u["model"].isNotNull() & (u["input_tokens"] + u["output_tokens"] + u["cache_read_tokens"] > 0), u)
    return X.once(X.once(counts, usage), some)


def _with_usage(records: DataFrame) -> DataFrame:
    """records (file, line, session_id, hint, own: times of the record's own, fallback, j) to rows of usage."""
    g = lambda p: F.get_json_object("j", p)
    stats = F.coalesce(g("$.stats"), g("$.result.stats"))
    models = F.map_entries(F.coalesce(F.from_json(F.get_json_object(stats, "$.models"), "map<string,string>"), F.expr("map()").cast("map<string,string>")))
    by_model = F.filter(F.transform(models, lambda e: _session_tokens(F.get_json_object(e["value"], "$.tokens"), e["key"], False)), lambda u: u.isNotNull())
    rest = F.array(_session_tokens(stats, F.coalesce("hint", F.lit("unknown")), False))
    direct = F.array(_session_tokens(g("$.tokens"), F.coalesce(g("$.model"), F.col("hint")), True))
    is_direct = g("$.type").eqNullSafe("gemini")
    usage = F.when(is_direct, direct).otherwise(X.once(by_model, lambda some: F.when(F.size(some) > 0, some).otherwise(rest)))
    own = F.when(is_direct, _moment(g("$.timestamp"), g("$.created_at"))).otherwise(_moment(g("$.timestamp")))
    # Exploded as it is: a filter on a column of it would hold it again.
    x = records.select("file", "line", "session_id", F.coalesce(own, "fallback").alias("ts"), F.when(is_direct, g("$.id")).alias("message_id"), F.explode(usage).alias("u")).where("u IS NOT NULL")
    return x.select("file", "line", "session_id", "ts", "message_id", "u.*", F.lit(0).cast("long").alias("cache_creation_tokens"))


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """Session files below a folder, each whole and so one row.  session_usage() takes files of lines from here only if it isn't
    given those of session_lines(), which reads them by byte ranges; else its filter by name leaves them unread."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,jsonl}").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """Session files of lines below a folder, read by byte ranges."""
    return lines_below(spark, path)


def session_usage(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Usage of session files (whole, and those of lines as session_lines gives them).  A document's messages count, or itself, or its totals by model.  In files of lines session
    and model carry forward and a message said again under its id replaces the one before.  A count in quotes counts too."""
    session = lambda j: F.coalesce(F.nullif(F.get_json_object(j, "$.sessionId"), F.lit("")), F.get_json_object(j, "$.session_id"))
    g = lambda p: F.get_json_object("value", p)
    document = files.where(F.endswith("file", F.lit(".json"))).withColumn("session_id", F.coalesce(session("value"), file_stem()))
    messages = F.from_json(g("$.messages"), "array<string>")
    within = document.where(messages.isNotNull()).select("file", "session_id", _moment(g("$.startTime"), g("$.lastUpdated")).alias("begun"), "modified", F.posexplode(messages).alias("line", "j"))
    within = within.where(F.get_json_object("j", "$.type") == "gemini").select("file", "line", "session_id", F.lit(None).cast("string").alias("hint"), F.coalesce("begun", "modified").alias("fallback"), "j")
    alone = document.where(messages.isNull()).select("file", F.lit(0).alias("line"), "session_id", g("$.model").alias("hint"), F.col("modified").alias("fallback"), F.col("value").alias("j"))
    if lines is None:
        lines = files.where(F.endswith("file", F.lit(".jsonl"))).select("file", "modified", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    kept = _places(lines)
    hints = lines.select(*kept, session("value").alias("session_id"), g("$.model").alias("hint"), F.col("modified").alias("fallback"), F.when(g("$").isNotNull(), F.col("value")).alias("j"))
    follow = carried(hints, last=("session_id", "hint")).where("j IS NOT NULL")
    follow = follow.select("file", "line", F.coalesce("session_id", file_stem()).alias("session_id"), "hint", "fallback", "j")
    said = _with_usage(follow)
    key = F.coalesce("message_id", F.concat_ws("|", F.lit(""), "line", "model"))
    last = said.groupBy("file", key.alias("k")).agg(F.max_by(F.struct(*said.columns), "line").alias("r")).select("r.*")
    return _with_usage(within.unionByName(alone)).unionByName(last)


def chat_usage(lines: DataFrame) -> DataFrame:
    """Usage of the assistant's lines that carry usage metadata; a session without a name has its project's and file's.
    lines has file, line, value and, if the files' times are known, modified."""
    said = F.contains("value", F.lit('"usageMetadata"')) & (F.get_json_object("value", "$.type") == "assistant")
    n = lambda p: F.greatest(F.coalesce(F.get_json_object("value", f"$.usageMetadata.{p}").try_cast("long"), F.lit(0)), F.lit(0))
    inp, cached = n("promptTokenCount"), n("cachedContentTokenCount")
    out = with_missing_total(inp, n("candidatesTokenCount"), cached, n("thoughtsTokenCount"), n("totalTokenCount"))
    project = F.coalesce(path_part("file", r".*(?:^|/)projects/([^/]+)/chats/[^/]+(?:/|$)"), F.lit("unknown"))
    modified = F.col("modified") if "modified" in lines.columns else F.lit(None).cast("timestamp")
    g = lambda p: F.get_json_object("value", p)
    rows = lines.select(*_places(lines), said.alias("said"), F.coalesce(g("$.sessionId"), F.concat_ws("-", project, file_stem())).alias("session_id"), F.coalesce(g("$.model"), F.lit("unknown")).alias("model"), F.coalesce(_moment(g("$.timestamp")), modified).alias("ts"), inp.alias("input_tokens"), out.alias("output_tokens"), cached.alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"))
    return _numbered(rows).where(F.col("said") & (X.total_tokens() > 0)).select("file", "line", *[c for c in rows.columns if c not in ("file", "line", "segment", "place", "said")])


CAPTURED = "generationId string, sessionId string, model string, tsMs bigint, inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, cacheCreationTokens bigint"


def captured_usage(lines: DataFrame) -> DataFrame:
    """Captured generations: the first line of an id in a file counts, also if it has no tokens and so no row."""
    x = _numbered(lines.select(*_places(lines), F.from_json("value", CAPTURED).alias("u"))).where("u.generationId IS NOT NULL AND u.tsMs IS NOT NULL")
    first = x.groupBy("file", F.col("u.generationId").alias("message_id")).agg(F.min_by("u", "line").alias("u"))
    counts = [F.coalesce(f"u.{a}Tokens", F.lit(0)).cast("long").alias(f"{b}_tokens") for a, b in (("input", "input"), ("output", "output"), ("cacheRead", "cache_read"), ("cacheCreation", "cache_creation"))]
    return first.select("file", "message_id", F.col("u.sessionId").alias("session_id"), "u.model", F.timestamp_millis("u.tsMs").alias("ts"), *counts).where(X.total_tokens() > 0)


def transcript_agent(column: str = "file") -> list[Column]:
    """Of a path below agent-transcripts: the session, and of a subagent its id, its parent's and its depth."""
    parts = F.split(F.regexp_extract(column, r"(?:^|/)agent-transcripts/(.*)$", 1), "/")
    stem = file_stem(column)
    name = F.when(stem.isin("transcript", "agent-transcript"), path_part(column, r"([^/]+)/[^/]+$")).otherwise(stem)
    at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i) == "subagents")
    depth = F.size(at)
    parent = F.when(depth == 1, F.get(parts, F.lit(0))).when(depth > 1, F.get(parts, F.element_at(at, -1) - 1))
    session = F.when((depth > 0) & (F.size(parts) >= 2), F.get(parts, F.lit(0))).otherwise(name)
    return [session.alias("session_id"), F.when(depth > 0, name).alias("agent_id"), parent.alias("agent_parent_id"), F.when(depth > 0, depth).alias("agent_depth")]


def unsent(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Lines of files (file, modified, size, value) that a cursor (file, modified, size, sent, prefix) hasn't sent: none of a
    file that is unchanged, those after the sent ones if their hash is still the same, else all."""
    c = cursors.select("file", F.col("modified").alias("c_modified"), F.col("size").alias("c_size"), "sent", "prefix")
    x = files.join(c, "file", "left").where(~(F.col("modified").eqNullSafe(F.col("c_modified")) & F.col("size").eqNullSafe(F.col("c_size"))))
    x = x.withColumn("lines", F.split("value", "\n"))
    same = F.coalesce(prefix_hash(F.col("lines"), F.col("sent")) == F.col("prefix"), F.lit(False))
    x = x.select("file", F.when(same, F.col("sent")).otherwise(0).alias("from"), F.posexplode("lines").alias("line", "value"))
    return x.where("line >= from AND value <> ''").select("file", "line", "value")


def prefix_hash(lines: Column, n: Column) -> Column:
    return F.sha2(F.array_join(F.slice(lines, F.lit(1), n), "\n"), 256)


#: Lines of plain transcripts that start a turn, and lines that are not part of a text.
TURN_MARK = r"^(user|A):\s*"
ASIDE_MARK = r"^\s*\[(?:Tool call|Tool result|Thinking|tool)\]"


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with the number of the turn they are in and its role, null before the first."""
    mark = F.nullif(F.regexp_extract("value", TURN_MARK, 1), F.lit(""))
    role = F.when(mark == "user", "user").when(mark == "A", "assistant")
    return carried(lines.select(*_places(lines), "value", role.alias("role"), mark.isNotNull().alias("begins")), last=("role",), counts={"turn": "role"})


def plain_turns(lines: DataFrame) -> DataFrame:
    """Turns of plain-text transcripts (file, line, value): text after a mark up to the next, without tool lines; turns
    without text go.  turn counts the marks of a file from 1."""
    x = _marked(lines).where(F.col("role").isNotNull() & (F.col("begins") | ~F.rlike("value", F.lit(ASIDE_MARK))))
    said = F.when(F.col("begins"), F.regexp_replace("value", TURN_MARK, "")).otherwise(F.col("value"))
    turns = x.groupBy("file", "turn", "role").agg(F.sort_array(F.collect_list(F.struct("line", said.alias("said")))).alias("said"))
    return turns.select("file", "turn", "role", F.btrim(F.array_join("said.said", "\n"), F.lit(" \n\r\t")).alias("text")).where("text <> ''")


def tool_key(name: Column) -> Column:
    """server.tool of a call to a server's tool, null of another call."""
    rest = F.regexp_extract(name, "^mcp__(.+)$", 1)
    server, tool = F.substring_index(rest, "__", 1), F.regexp_replace(rest, "^.*?__", "")
    return F.when(rest.contains("__") & (server != "") & (tool != ""), F.concat_ws(".", server, F.regexp_replace(tool, "__", ".")))


def plain_tools(lines: DataFrame) -> DataFrame:
    """Calls of servers' tools in the assistant's turns of plain-text transcripts, in order from 0."""
    key = tool_key(F.regexp_extract("value", r"^\s*\[Tool call\]\s*([^\s(]+)", 1))
    calls = _marked(lines).where("role = 'assistant' AND NOT begins").select("file", "line", key.alias("item_key")).where("item_key IS NOT NULL")
    return carried(calls, counts={"call": "item_key"}).withColumn("call", (F.col("call") - 1).cast("int"))
