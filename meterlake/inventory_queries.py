"""Named queries on parsers, small joins, shares, periods and rollup state, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import exprs as X
from .functions import timeutil
from .operators import compare, deploy, history, ingest, pricing, repair, tools, usage
from .plans import jobs, rollup
from .queries import _COMP, _TURNS, _TWO, BASE, COST, COVER, PERIOD, SCOPE, SEOUL, TEAMED, TOKENS, YORK, M, both, ev, label, query, teamed, turns
from .sources import logs, segments, wire
from .sources import tables as T

table = T.table


# Parsers

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def iso(c: str = "ts"):
    return F.date_format(c, _ISO)


def attr(key: str, value, kind: str = "stringValue"):
    parts = {"stringValue": F.lit(None).cast("string"), "intValue": F.lit(None).cast("string")} | {kind: value.cast("string")}
    return F.struct(F.lit(key).alias("key"), F.struct(*[v.alias(k) for k, v in parts.items()]).alias("value"))


@query("src8_log_exports", f"""WITH {T.EV} SELECT host, session_id, model, ts, input_tokens - CASE WHEN user_id % 2 = 0 THEN cache_read_tokens ELSE 0 END AS input_tokens, output_tokens, cache_read_tokens
 FROM ev WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND output_tokens + input_tokens > 0""")
def _(spark, d):
    """Exports of one record an event: every third isn't a request, every fifth has no time."""
    e, i = T.usage_events(spark, d), F.col("event_id")
    nanos = F.when(i % 5 == 0, "0").otherwise(F.concat(F.unix_micros("ts").cast("string"), F.lit("000")))
    name = F.when(i % 3 == 0, "user_prompt").otherwise("tool.api_request")
    counts = [attr("input_tokens", F.col("input_tokens"), "intValue"), attr("output_tokens", F.col("output_tokens"), "intValue"), attr("cache_read_tokens", F.col("cache_read_tokens"), "intValue")]
    kept = F.filter(F.array(attr("session.id", F.col("session_id")), attr("model", F.col("model")), attr("prompt", F.lit("secret")), *counts), lambda a: a["value"]["stringValue"].isNotNull() | a["value"]["intValue"].isNotNull())
    record = F.struct(nanos.alias("timeUnixNano"), name.alias("eventName"), kept.alias("attributes"))
    service = F.when(F.col("user_id") % 2 == 0, "codex-cli").otherwise("other")
    resource = F.struct(F.array(attr("service.name", service), attr("host.name", F.coalesce("host", F.lit(" ")))).alias("attributes"))
    export = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.struct(F.lit("s").alias("name")).alias("scope"), F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    rows = logs.requests(logs.otlp_records(e.select(F.to_json(export).alias("payload"))))
    return rows.select("host", "session_id", "model", F.col("ts").cast("timestamp_ntz").alias("ts"), "input_tokens", "output_tokens", "cache_read_tokens")


@query("src9_wire_events", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'dedupKey' WHEN event_id % 6 = 1 THEN 'ts' WHEN event_id % 6 = 2 THEN 'inputTokens' WHEN event_id % 6 = 3 THEN 'cacheCreation1hTokens' END AS error FROM events")
def _(spark, d):
    """Wire events, four of six with a fault."""
    e, i = T.usage_events(spark, d), F.col("event_id") % 6
    body = F.struct(F.when(i == 0, "").otherwise(F.col("dedup_key")).alias("dedupKey"), F.col("provider_key").alias("providerKey"), F.col("event_id").cast("string").alias("userId"), F.when(i == 1, "never").otherwise(iso()).alias("ts"), F.when(i == 2, -1).otherwise(F.col("input_tokens")).alias("inputTokens"), F.col("output_tokens").alias("outputTokens"), F.col("cache_read_tokens").alias("cacheReadTokens"), F.col("cache_creation_tokens").alias("cacheCreationTokens"), F.when(i == 3, F.col("cache_creation_tokens") + 1).alias("cacheCreation1hTokens"))
    return logs.wire_events(e.select(F.to_json(body).alias("value"))).select(F.col("userId").cast("long").alias("event_id"), "error")


@query("src10_tool_activity", f"""WITH {T.TOOLS} SELECT event_id, activity_kind, item_key, CASE WHEN event_id % 6 = 3 THEN 'maybe' ELSE outcome END AS outcome,
 CASE event_id % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'dedupKey' WHEN 2 THEN 'ts' WHEN 3 THEN 'outcome' END AS error FROM tl""")
def _(spark, d):
    t, i = T.tool_events(spark, d), F.col("event_id") % 6
    item = F.struct(F.when(i == 1, "short").otherwise(F.sha2(F.col("event_id").cast("string"), 256)).alias("dedupKey"), F.lit("p").alias("providerKey"), F.col("session_id").alias("sessionId"), F.col("host"), F.when(i == 2, "soon").otherwise(iso()).alias("ts"), F.col("activity_kind").alias("activityKind"), F.col("item_key").alias("itemKey"), F.col("item_key").alias("displayName"), F.when(i == 3, "maybe").otherwise(F.col("outcome")).alias("outcome"), F.lit("explicit").alias("detection"), F.when(i == 0, "x").alias("more"))
    bodies = t.select("event_id", F.to_json(F.array(item)).alias("value"))
    return wire.activity(bodies).select("event_id", "activity_kind", "item_key", "outcome", "error")


@query("src10_tool_inventory", """SELECT s_suppkey, item AS position, 'i' || item AS item_key, CASE WHEN s_suppkey % 4 = 0 THEN 'fingerprint' WHEN s_suppkey % 4 = 1 AND item = 1 THEN 'item.kind' END AS error
 FROM supplier, (SELECT unnest([0, 1, 2])::INT AS item)""")
def _(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    kind = lambda j: F.when((k % 4 == 1) & (j == 1), "hook").otherwise("mcp")
    one = lambda j: F.struct(kind(j).alias("kind"), F.concat(F.lit("i"), j.cast("string")).alias("itemKey"), F.lit("n").alias("displayName"), F.lit("p").alias("sourceProvider"), (j == 0).alias("enabled"))
    body = F.struct(F.col("s_name").alias("host"), F.when(k % 4 == 0, "none").otherwise(F.sha2(k.cast("string"), 256)).alias("fingerprint"), F.lit("2024-01-01T00:00:00Z").alias("observedAt"), F.transform(F.array(*map(F.lit, range(3))), one).alias("items"))
    return wire.inventory(s.select("s_suppkey", F.to_json(body).alias("value"))).select("s_suppkey", "position", "item_key", "error")


@query("src11_prompts", "SELECT conv_id, turn, role AS turn_role, text, CASE WHEN turn % 3 = 0 THEN 'a' END AS agent_id, CASE WHEN role NOT IN ('user', 'assistant') THEN 'turnRole' WHEN coalesce(text, '') = '' THEN 'text' WHEN turn % 3 = 0 AND conv_id % 2 = 0 THEN 'agent.depth' END AS error FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    agent = F.when(F.col("turn") % 3 == 0, F.struct(F.lit("a").alias("id"), F.when(F.col("conv_id") % 2 == 0, 33).otherwise(2).alias("depth")))
    item = F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("dedupKey"), F.lit("p").alias("providerKey"), F.col("conv_id").cast("string").alias("sessionId"), F.col("role").alias("turnRole"), F.lit("2024-01-01T00:00:00Z").alias("ts"), "text", agent.alias("agent"))
    return wire.prompts(c.select("conv_id", "turn", F.to_json(F.array(item)).alias("value"))).select("conv_id", "turn", "turn_role", "text", "agent_id", "error")


def lines(spark, d, *columns) -> DataFrame:
    """Events as lines of a file for each user."""
    e = T.usage_events(spark, d)
    return e.select(F.concat(F.lit("/home/projects/p/chats/u"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("event_id").alias("line"), *columns)


@query("src12_assistant_transcripts", f"WITH {T.EV} SELECT event_id AS line, session_id, model, ts, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens FROM ev WHERE provider_key <> 'click' AND event_id % 9 <> 0 AND tokens > 0")
def _(spark, d):
    n = lambda c: F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.col(c))
    counts = F.struct(n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"), n("cache_read_tokens").alias("cache_read_input_tokens"), n("cache_creation_tokens").alias("cache_creation_input_tokens"))
    value = F.struct(F.when(F.col("provider_key") == "click", "user").otherwise("assistant").alias("type"), F.col("session_id").alias("sessionId"), iso().alias("timestamp"), F.struct("model", counts.alias("usage")).alias("message"))
    out = logs.assistant_usage(lines(spark, d, F.to_json(value).alias("value")))
    return out.where("input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens > 0").select("line", "session_id", "model", F.col("ts").cast("timestamp_ntz").alias("ts"), *[f"{x}_tokens" for x in ("input", "output", "cache_read", "cache_creation")])


@query("src13_rollouts", f"""WITH {T.EV}, c AS (SELECT *, count(*) FILTER (WHERE provider_key = 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM ev),
m AS (SELECT *, last_value(CASE WHEN provider_key = 'view' THEN coalesce(model, '') END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS hint FROM ev),
t AS (SELECT *, event_id // 2 AS total, lag(event_id // 2) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM m WHERE provider_key <> 'view')
SELECT event_id AS line, hint AS model, input_tokens - cache_read_tokens AS input_tokens, output_tokens, cache_read_tokens FROM t WHERE total IS DISTINCT FROM was AND input_tokens > 0""")
def _(spark, d):
    """The model carries forward from turns (here, of views); totals said again are passed over."""
    turn = F.struct(F.lit("turn_context").alias("type"), F.struct(F.coalesce("model", F.lit("")).alias("model")).alias("payload"))
    last = F.struct("input_tokens", "output_tokens", F.col("cache_read_tokens").alias("cached_input_tokens"))
    info = F.struct(F.struct(F.floor(F.col("event_id") / 2).alias("total_tokens")).alias("total_token_usage"), last.alias("last_token_usage"))
    count = F.struct(F.lit("event_msg").alias("type"), iso().alias("timestamp"), F.struct(F.lit("token_count").alias("type"), info.alias("info")).alias("payload"))
    value = F.when(F.col("provider_key") == "view", F.to_json(turn)).otherwise(F.to_json(count))
    return logs.rollout_usage(lines(spark, d, value.alias("value"))).select("line", "model", "input_tokens", "output_tokens", "cache_read_tokens")


@query("src14_session_files", f"WITH {T.EV} SELECT session_id, coalesce(model, 'unknown') AS model, ts, input_tokens - cache_read_tokens + cache_creation_tokens AS input_tokens, output_tokens, cache_read_tokens FROM ev WHERE session_id IS NOT NULL AND model IS NOT NULL AND input_tokens > 0")
def _(spark, d):
    """A document of one message an event, whose total shows that cached tokens are within the input."""
    e = T.usage_events(spark, d)
    t = F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read_tokens").alias("cached"), F.col("cache_creation_tokens").alias("tool"), (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens")).alias("total"))
    message = F.struct(F.lit("gemini").alias("type"), "model", iso().alias("timestamp"), t.alias("tokens"))
    value = F.to_json(F.struct(F.col("session_id").alias("sessionId"), F.array(message).alias("messages")))
    files = e.where("session_id IS NOT NULL").select(F.concat(F.lit("/s/"), F.col("event_id").cast("string"), F.lit(".json")).alias("file"), F.lit("2024-01-01").cast("timestamp").alias("modified"), value.alias("value"))
    return logs.session_usage(files).select("session_id", "model", F.col("ts").cast("timestamp_ntz").alias("ts"), "input_tokens", "output_tokens", "cache_read_tokens")


@query("src15_chat_files", f"WITH {T.EV} SELECT event_id AS line, coalesce(session_id, 'p-u' || user_id) AS session_id, coalesce(model, 'unknown') AS model, ts, input_tokens, output_tokens + cache_creation_tokens AS output_tokens, cache_read_tokens FROM ev WHERE provider_key <> 'error' AND input_tokens > 0")
def _(spark, d):
    """The total has more than the known counts, and the rest is output."""
    c = F.col
    meta = F.struct(c("input_tokens").alias("promptTokenCount"), c("output_tokens").alias("candidatesTokenCount"), c("cache_read_tokens").alias("cachedContentTokenCount"), X.total_tokens().alias("totalTokenCount"))
    value = F.struct(F.when(c("provider_key") == "error", "user").otherwise("assistant").alias("type"), c("session_id").alias("sessionId"), "model", iso().alias("timestamp"), meta.alias("usageMetadata"))
    return logs.chat_usage(lines(spark, d, F.to_json(value).alias("value"))).select("line", "session_id", "model", F.col("ts").cast("timestamp_ntz").alias("ts"), "input_tokens", "output_tokens", "cache_read_tokens")


@query("src16_captured_generations", f"WITH {T.EV}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id // 200 ORDER BY event_id) AS n FROM ev) SELECT 'g' || (event_id // 200) AS message_id, session_id, model, date_trunc('millisecond', ts) AS ts, input_tokens, output_tokens FROM f WHERE n = 1 AND input_tokens > 0")
def _(spark, d):
    """The first line of a generation counts."""
    c = F.col
    value = F.struct(F.concat(F.lit("g"), F.floor(c("event_id") / 200).cast("string")).alias("generationId"), c("session_id").alias("sessionId"), "model", F.unix_millis("ts").alias("tsMs"), c("input_tokens").alias("inputTokens"), c("output_tokens").alias("outputTokens"))
    out = logs.captured_usage(lines(spark, d, F.to_json(value).alias("value")))
    return out.select("message_id", "session_id", "model", F.col("ts").cast("timestamp_ntz").alias("ts"), "input_tokens", "output_tokens")


@query("src18_unsent_lines", """WITH l AS (SELECT c_custkey AS k, n::INT AS line FROM customer, (SELECT unnest(range(4)) AS n))
SELECT '/f/' || k AS file, line, 'l' || line || '-' || k AS value FROM l WHERE k % 4 <> 0 AND (k % 4 <> 1 OR line >= 2)""")
def _(spark, d):
    """Of four files one is unchanged, one has two lines sent, one was rewritten, one is new."""
    k = F.col("c_custkey")
    text = F.array(*[F.concat(F.lit(f"l{n}-"), k.cast("string")) for n in range(4)])
    c = table(spark, d, "customer").select(k, F.concat(F.lit("/f/"), k.cast("string")).alias("file"), text.alias("text"), F.lit("2024-01-02").cast("timestamp").alias("modified"), F.lit(40).alias("size"))
    before = F.when(k % 4 == 0, F.col("modified")).otherwise(F.lit("2024-01-01").cast("timestamp"))
    cursors = c.where(k % 4 != 3).select("file", before.alias("modified"), "size", F.lit(2).alias("sent"), F.when(k % 4 == 2, "other").otherwise(logs.prefix_hash(F.col("text"), F.lit(2))).alias("prefix"))
    return logs.unsent(c.select("file", "modified", "size", F.array_join("text", "\n").alias("value")), cursors)


@query("src19_price_list", "SELECT 'part' || p_partkey AS model_id, round(p_size * 1e-7 * 1e6, 8) AS input, round(p_partkey * 1e-8 * 1e6, 8) AS output FROM part WHERE p_partkey % 5 <> 0")
def _(spark, d):
    k = F.col("p_partkey")
    price = F.struct((F.col("p_size") * F.lit(1e-7)).alias("input_cost_per_token"), F.when(k % 5 != 0, k * F.lit(1e-8)).alias("output_cost_per_token"))
    text = table(spark, d, "part").select(F.to_json(F.create_map(F.concat(F.lit("part"), k.cast("string")), price)).alias("value"))
    return logs.price_list(spark, text).select("model_id", "input", "output")


@query("src21_inventory_fingerprint", """WITH i AS (SELECT DISTINCT l_suppkey AS device, l_returnflag AS kind, 'k' || (l_partkey % 3) AS item FROM lineitem)
SELECT device, sha256(string_agg(kind || '|' || item, chr(10) ORDER BY kind, item)) AS fingerprint, count(*)::INT AS items FROM i GROUP BY 1""")
def _(spark, d):
    """What a device has, as a set: the same things have the same fingerprint in any order."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("device"), F.concat_ws("|", "l_returnflag", F.concat(F.lit("k"), (F.col("l_partkey") % 3).cast("string"))).alias("x")).distinct()
    listed = li.groupBy("device").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return listed.select("device", F.sha2(F.array_join("x", "\n"), 256).alias("fingerprint"), F.size("x").alias("items"))


# Sinks


@query("snk5_hourly_rollup", f"WITH {T.EV} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, provider_key, coalesce(model, '') AS model, count(*) AS events, {TOKENS}, sum(cost_usd)::DOUBLE AS cost FROM ev GROUP BY 1, 2, 3")
def _(spark, d):
    e = T.usage_events(spark, d)
    return e.groupBy(X.bucket_start("ts", 60).cast("timestamp_ntz").alias("bucket"), "provider_key", F.coalesce("model", F.lit("")).alias("model")).agg(F.count(F.lit(1)).alias("events"), *X.tokens(), F.sum("cost_usd").cast("double").alias("cost"))


@query("snk10_snapshot_replace", "SELECT l_suppkey AS device, l_orderkey AS snapshot, l_partkey AS item FROM (SELECT *, max(l_orderkey) OVER (PARTITION BY l_suppkey) AS last FROM lineitem) WHERE l_orderkey = last")
def _(spark, d):
    """The items of each device's latest snapshot."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("device"), F.col("l_orderkey").alias("snapshot"), F.col("l_partkey").alias("item"))
    last = li.groupBy("device").agg(F.max("snapshot").alias("snapshot"))
    return li.join(last, ["device", "snapshot"], "left_semi")


@query("snk11_host_versions", "WITH v AS (SELECT user_id, 'h' || (event_id % 3) AS host, event_id % 5 || '.0.' || (event_id % 7) AS version, event_id FROM events) SELECT user_id, host, arg_max(version, event_id) AS version FROM v GROUP BY 1, 2")
def _(spark, d):
    i = F.col("event_id")
    seen = table(spark, d, "events").select("user_id", i, F.array(F.struct(F.concat(F.lit("h"), (i % 3).cast("string")).alias("host"), F.concat((i % 5).cast("string"), F.lit(".0."), (i % 7).cast("string")).alias("version"))).alias("hosts"))
    return seen.select("user_id", "event_id", F.inline("hosts")).groupBy("user_id", "host").agg(F.max_by("version", "event_id").alias("version"))


@query("snk12_metadata_backfill", "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'old' WHEN turn % 2 = 0 THEN 'new' END AS agent_id FROM conversations")
def _(spark, d):
    """Only rows without an agent take the one that comes in."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, "old").alias("agent_id"))
    found = c.where("turn % 2 = 0").select("conv_id", "turn", F.lit("new").alias("found"))
    return c.join(found, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("agent_id", "found").alias("agent_id"))


@query("snk14_lifetimes", f"WITH {T.EV} SELECT provider_key, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-04-20' - INTERVAL 97 DAY) AS raw, count(DISTINCT time_bucket(INTERVAL 15 MINUTE, ts)) FILTER (WHERE ts >= TIMESTAMP '2025-02-15' - INTERVAL 400 DAY) AS buckets FROM ev GROUP BY 1")
def _(spark, d):
    """What is left of raw events after 97 days, and of buckets after 400."""
    since = lambda now, days: F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return T.usage_events(spark, d).groupBy("provider_key").agg(F.count_if(since("2024-04-20", 97)).alias("raw"), F.countDistinct(F.when(since("2025-02-15", 400), X.bucket_start("ts"))).alias("buckets"))


# Filters


@query("flt3_provider_identification", f"WITH {T.EV}, p AS (SELECT * FROM (VALUES ('view', 'views'), ('click', 'clicks')) AS v(service, key)) SELECT key, count(*) AS events FROM ev LEFT JOIN p ON service = provider_key GROUP BY 1")
def _(spark, d):
    """Names of services are listed with each provider; an enabled provider goes before a disabled one."""
    p = spark.sql("SELECT * FROM VALUES ('views', array('view', 'look'), true), ('old', array('click'), false), ('clicks', array('click'), true) AS p(key, patterns, enabled)")
    names = p.select("key", "enabled", F.explode("patterns").alias("service")).groupBy("service").agg(F.min_by("key", F.struct(~F.col("enabled"), "key")).alias("key"))
    return T.usage_events(spark, d).join(names, F.col("provider_key") == F.col("service"), "left").groupBy("key").agg(F.count(F.lit(1)).alias("events"))


@query("flt4_request_events", "SELECT event_type, count(*) AS events FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def _(spark, d):
    t = F.col("event_type")
    name = F.when(t == "view", "api_request").when(t == "click", "tool.api_request").when(t == "error", "api_request.failed").otherwise(t)
    return table(spark, d, "events").where(logs.is_request(name)).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("flt7_denied_attributes", "SELECT conv_id, turn, 'role' AS names FROM conversations")
def _(spark, d):
    keys = F.map_from_arrays(F.array(*map(F.lit, ["role", *logs.DENIED])), F.array(F.col("role"), *[F.col("text") for _ in logs.DENIED]))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.map_keys(logs.without_text(keys)), ",").alias("names"))


@query("flt9_group_host", f"WITH {T.EV} SELECT user_id, arg_min(coalesce(CASE WHEN event_id % 4 = 0 THEN 'own' END, host), event_id) FILTER (WHERE event_id % 4 = 0 OR host IS NOT NULL) AS host FROM ev GROUP BY 1")
def _(spark, d):
    """The first machine that a record names, by a deployment's own attribute or else the usual one."""
    own = F.when(F.col("event_id") % 4 == 0, "own")
    e = T.usage_events(spark, d).select("user_id", "event_id", F.map_from_arrays(F.array(F.lit("my.host"), F.lit("host.name")), F.array(own, F.col("host"))).alias("resource"))
    return e.groupBy("user_id").agg(logs.group_host("resource", "event_id", ("my.host", *logs.HOSTS)).alias("host"))


@query("flt14_token_validity", "SELECT c_custkey AS token_id FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 4 <> 0 OR c_custkey % 8 = 4) AND c_custkey % 2 = 0")
def _(spark, d):
    """Offered tokens (even ones) that have a row which isn't revoked or expired."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k)
    at = lambda x: F.lit(x).cast("timestamp")
    held = c.select(k.alias("token_id"), F.sha2(k.cast("string"), 256).alias("token_hash"), F.when(k % 3 == 0, at("2024-01-01")).alias("revoked_at"), F.when(k % 8 == 4, at("2024-02-01")).when(k % 4 == 0, at("2024-01-10")).alias("expires_at"))
    offered = c.where(k % 2 == 0).select(F.sha2(k.cast("string"), 256).alias("token_hash"))
    now = at("2024-01-15")
    return held.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).join(offered, "token_hash", "left_semi").select("token_id")


@query("flt16_visibility", "SELECT p_partkey AS item, p_size % 4 <> 0 AS listed, p_size % 4 <> 3 OR p_partkey % 5 = 1 AS readable FROM part")
def _(spark, d):
    """Drafts aren't listed; archived items open for their owner (here 1) alone."""
    state = F.element_at(F.array(*map(F.lit, ["draft", "published", "deprecated", "archived"])), (F.col("p_size") % 4 + 1).cast("int"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), state.alias("state"), (F.col("p_partkey") % 5).alias("owner"))
    return items.select("item", (F.col("state") != "draft").alias("listed"), ((F.col("state") != "archived") | (F.col("owner") == 1)).alias("readable"))


@query("flt17_owner_rows", f"WITH {T.EV} SELECT event_id FROM ev WHERE user_id = 12 AND {PERIOD}")
def _(spark, d):
    return usage.scan(T.usage_events(spark, d), usage.Scope(SCOPE.start, SCOPE.end, user=12)).select("event_id")


# Joins


@query("jn2_team_labels", f"{TEAMED} SELECT n_name AS label, count(*) AS events, {COST} FROM p JOIN nation ON n_nationkey = team_id GROUP BY 1")
def _(spark, d):
    """Inner: teams without a row vanish.  Summed by key first, so that labels meet sums alone."""
    sums = usage.scan(teamed(spark, d), SCOPE).groupBy("team_id").agg(F.count(F.lit(1)).alias("events"), X.priced_cost().alias("cost"))
    return sums.join(T.teams(spark, d), "team_id").select("label", "events", "cost")


@query("jn3_label_fallback", f"{BASE}, u AS (SELECT user_id, count(*) AS events FROM p GROUP BY 1) SELECT user_id, events, coalesce(c_name, user_id::VARCHAR) AS label FROM u LEFT JOIN customer ON c_custkey = user_id")
def _(spark, d):
    sums = ev(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return sums.join(T.users(spark, d), "user_id", "left").withColumn("label", F.coalesce("label", F.col("user_id").cast("string")))


_NAMES = "('gpt-5', 1), ('claude-x', 2), ('claude-x-pro', 3), ('o9-20240101', 4)"
_ASKED = ["gpt-5", "openai/gpt-5", "bedrock/claude-x-20250101", "anthropic.claude-x-pro-v2", "o9", "none", "us.anthropic.claude-x"]


@query("jn6_alias_lookup", f"""WITH k AS (SELECT * FROM (VALUES {_NAMES}) AS v(model_id, n)), m AS (SELECT unnest({_ASKED}) AS model), s AS (SELECT model, regexp_replace(model, '^(us\\.anthropic\\.|anthropic\\.|openai/|bedrock/)', '') AS p FROM m),
x AS (SELECT *, regexp_replace(p, '-\\d{{8}}$', '') AS q FROM s), r AS (SELECT model, model_id, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN model_id = model THEN 0 WHEN model_id = p THEN 1 WHEN model_id = q THEN 2 ELSE 3 END, length(model_id) DESC, model_id) AS n
FROM x JOIN k ON model_id IN (model, p, q) OR contains(p, model_id) OR contains(model_id, q)) SELECT model, model_id FROM r WHERE n = 1""")
def _(spark, d):
    keys = spark.sql(f"SELECT model_id FROM VALUES {_NAMES} AS v(model_id, n)")
    return pricing.aliases(spark.createDataFrame([(x,) for x in _ASKED], "model string"), keys)


@query("jn7_session_page", f"WITH {T.EV}, g AS (SELECT session_id, max(ts) AS last FROM ev WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY last DESC, session_id LIMIT 20) SELECT session_id, {COST}, {TOKENS}, {COVER} FROM ev SEMI JOIN g USING (session_id) GROUP BY 1")
def _(spark, d):
    """Usage of the sessions on a page of the twenty newest."""
    e = T.usage_events(spark, d)
    page = e.where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "session_id").limit(20)
    return e.join(F.broadcast(page), "session_id", "left_semi").groupBy("session_id").agg(X.priced_cost().alias("cost"), *X.tokens(), *X.coverage())


@query("jn9_exact_twins", f"""WITH {T.EV}, tw AS (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN model END AS model, 'unpriced' AS cost_status) FROM ev UNION ALL SELECT * FROM ev WHERE event_id % 3 = 0)
SELECT event_id FROM tw a WHERE model IS NULL AND cost_status = 'unpriced' AND EXISTS (SELECT 1 FROM tw b WHERE b.model IS NOT NULL AND a.user_id = b.user_id AND a.session_id IS NOT DISTINCT FROM b.session_id AND a.host IS NOT DISTINCT FROM b.host AND a.ts = b.ts AND a.input_tokens = b.input_tokens AND a.output_tokens = b.output_tokens AND a.cache_read_tokens = b.cache_read_tokens AND a.cache_creation_tokens = b.cache_creation_tokens)""")
def _(spark, d):
    e = T.usage_events(spark, d)
    bare = e.withColumn("model", F.when(F.col("event_id") % 2 == 0, F.col("model"))).withColumn("cost_status", F.lit("unpriced"))
    return ingest.replayed(bare.unionByName(e.where("event_id % 3 = 0"))).select("event_id")


@query("jn12_zone_units", f"WITH b AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS ts FROM events) SELECT DISTINCT '{SEOUL}' AS zone, 'day' AS unit, {label(SEOUL)} AS label FROM b UNION SELECT '{SEOUL}', 'hour', {label(SEOUL, '%Y-%m-%d %H:00')} FROM b UNION SELECT '{YORK}', 'day', {label(YORK)} FROM b UNION SELECT '{YORK}', 'hour', {label(YORK, '%Y-%m-%d %H:00')} FROM b")
def _(spark, d):
    return jobs.affected_jobs(ingest.dirty_buckets(T.usage_events(spark, d)), [SEOUL, YORK])


@query("jn13_snapshot_items", "SELECT s_suppkey AS device, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS items FROM supplier LEFT JOIN lineitem ON CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END = s_suppkey GROUP BY 1")
def _(spark, d):
    """Devices with what they have; one that has nothing stays.  Items of every seventh device name none."""
    items = table(spark, d, "lineitem").groupBy(F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("device")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("items"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("device")).join(items, "device", "left").na.fill("", ["items"])


@query("jn15_last_used", "SELECT c_custkey AS user_id, max(ts) AS last_used, count(event_id) AS events FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def _(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_used"), F.count(F.lit(1)).alias("events"))
    return T.users(spark, d).select("user_id").join(last, "user_id", "left").na.fill(0, ["events"])


@query("jn18_device_rows", f"""WITH {T.EV}, u AS (SELECT host, count(*) AS events FROM ev GROUP BY 1), i AS (SELECT s_suppkey AS device, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN 'new' ELSE 'h' || (s_suppkey % 7) END AS host FROM supplier),
c AS (SELECT *, count(*) OVER (PARTITION BY host) > 1 AS shared FROM i)
SELECT device, c.host, events, shared FROM c LEFT JOIN u ON u.host IS NOT DISTINCT FROM c.host UNION ALL SELECT NULL, host, events, false FROM u WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.host IS NOT DISTINCT FROM u.host)""")
def _(spark, d):
    s = F.col("s_suppkey")
    inventory = table(spark, d, "supplier").select(s.alias("device"), F.when(s % 5 != 0, F.when(s % 7 == 1, "new").otherwise(F.concat(F.lit("h"), (s % 7).cast("string")))).alias("host"))
    return deploy.device_rows(inventory, usage.devices(T.usage_events(spark, d)).select("host", "events"))


@query("jn21_first_record", "SELECT c_custkey AS user_id, min(o_orderkey) AS first_record, count(o_orderkey) > 0 AS has_records FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def _(spark, d):
    first = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").alias("first_record"))
    return T.users(spark, d).select("user_id").join(first, "user_id", "left").withColumn("has_records", F.col("first_record").isNotNull())


# Windows, order, sets


@query("win4_representative_turn", f"{_TURNS} SELECT DISTINCT ON (session) session, turn, role FROM t ORDER BY session, (role = 'user') DESC, turn")
def _(spark, d):
    """One row of each key without a sort of all rows: the least by an order, as an aggregate."""
    order = F.struct((F.col("role") != "user").alias("a"), "turn")
    return turns(spark, d).groupBy("session").agg(F.min_by(F.struct("turn", "role"), order).alias("t")).select("session", "t.*")


@query("win5_carry_forward", f"WITH {T.EV} SELECT event_id, last_value(model IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS model FROM ev")
def _(spark, d):
    return segments.carried(T.usage_events(spark, d).select("user_id", "event_id", "model"), "user_id", "event_id", ("model",)).select("event_id", "model")


@query("top1_most_tokens", f"{BASE} SELECT session_id, sum(tokens)::BIGINT AS tokens FROM p WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY tokens DESC, session_id LIMIT 100")
def _(spark, d):
    s = ev(spark, d).where("session_id IS NOT NULL").groupBy("session_id").agg(F.sum(X.total_tokens()).cast("long").alias("tokens"))
    return s.orderBy(F.desc("tokens"), "session_id").limit(100)


@query("top6_share_changes", f"{_TWO}, c AS ({_COMP}), s AS (SELECT key, current_tokens / sum(current_tokens) OVER () * 100 AS a, previous_tokens / sum(previous_tokens) OVER () * 100 AS b FROM c WHERE dimension = 'model') SELECT key, round(a, 6) AS current_share, round(b, 6) AS previous_share, round(a - b, 6) AS delta FROM s ORDER BY abs(a - b) DESC, key LIMIT 5")
def _(spark, d):
    return compare.share_changes(compare.composition(both(spark, d)).where("dimension = 'model'"))


@query("top8_best_tools", f"WITH {T.TOOLS} SELECT item_key, count(*) FILTER (WHERE outcome = 'success') AS successes FROM tl GROUP BY 1 ORDER BY successes DESC, item_key LIMIT 3")
def _(spark, d):
    return T.tool_events(spark, d).groupBy("item_key").agg(F.count_if(F.col("outcome") == "success").alias("successes")).orderBy(F.desc("successes"), "item_key").limit(3)


@query("set2_legitimate_keys", "SELECT event_id FROM events EXCEPT SELECT event_id FROM events WHERE event_id % 6 = 0")
def _(spark, d):
    e = table(spark, d, "events").select("event_id")
    return e.join(e.where("event_id % 6 = 0"), "event_id", "left_anti")


@query("set3_distinct_pairs", f"WITH {T.EV} SELECT DISTINCT provider_key, model FROM ev")
def _(spark, d):
    return T.usage_events(spark, d).select("provider_key", "model").distinct()


@query("set4_scalar_subquery", f"WITH {T.EV}, u AS (SELECT user_id, count(*) AS events FROM ev GROUP BY 1) SELECT user_id, events, (SELECT max(events) FROM u) AS most FROM u WHERE events > (SELECT avg(events) FROM u)")
def _(spark, d):
    u = T.usage_events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return u.crossJoin(F.broadcast(u.agg(F.max("events").alias("most"), F.avg("events").alias("mean")))).where("events > mean").drop("mean")


@query("set7_json_recordset", "SELECT conv_id, turn, 'a' || turn AS agent FROM conversations")
def _(spark, d):
    """A JSON list a session, read back as rows."""
    record = F.to_json(F.struct("turn", F.concat(F.lit("a"), F.col("turn").cast("string")).alias("agent")))
    c = table(spark, d, "conversations").select("conv_id", F.concat(F.lit("["), record, F.lit("]")).alias("records"))
    return c.select("conv_id", F.inline(F.from_json("records", "array<struct<turn:bigint,agent:string>>")))


# Periods and rollup state


_ZONED = "CASE n % 4 WHEN 0 THEN 'Asia/Seoul' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Europe/Berlin' ELSE 'Etc/UTC' END"


def zone_of(n):
    return F.when(n % 4 == 0, SEOUL).when(n % 4 == 1, YORK).when(n % 4 == 2, "Europe/Berlin").otherwise("Etc/UTC")


@query("tim3_first_instants", f"WITH x AS (SELECT DISTINCT o_orderdate::DATE AS wall, o_orderkey % 4 AS n FROM orders) SELECT strftime(wall, '%Y-%m-%d') AS day, {_ZONED} AS zone, timezone('UTC', timezone({_ZONED}, wall::TIMESTAMP)) AS first_instant FROM x")
def _(spark, d):
    """The first instants of all days on which something was ordered, in four zones, over many changes of clocks."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("day"), zone_of(F.col("o_orderkey")).alias("zone")).distinct()
    return days.withColumn("first_instant", X.first_instant(F.col("day"), F.col("zone")))


@query("tim4_calendar", "SELECT event_id, (ts::DATE - CAST(dayofweek(ts) AS INT))::DATE AS week, date_trunc('quarter', ts)::DATE AS quarter, (ts::DATE + INTERVAL 1 MONTH)::DATE AS month_later FROM events")
def _(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").select("event_id", F.date_sub(day, F.dayofweek(day) - 1).alias("week"), F.trunc(day, "quarter").alias("quarter"), F.add_months(day, 1).alias("month_later"))


_AT = datetime(2024, 1, 24, 12, 34, 56, tzinfo=UTC)


@query("tim5_preset_usage", f"WITH {T.EV}, l AS (SELECT *, timezone('{SEOUL}', timezone('UTC', ts)) AS wall FROM ev) " + " UNION ALL ".join(f"SELECT '{n}' AS preset, '{s}' AS side, count(*) AS events FROM l WHERE wall >= TIMESTAMP '{a}' AND wall < TIMESTAMP '{b}'" for n, s, a, b in [("today", "current", "2024-01-24", "2024-01-25"), ("today", "previous", "2024-01-23", "2024-01-24"), ("week", "current", "2024-01-21", "2024-01-25"), ("week", "previous", "2024-01-14", "2024-01-21"), ("month", "current", "2024-01-01", "2024-01-25"), ("month", "previous", "2023-12-01", "2024-01-01"), ("7d", "current", "2024-01-18", "2024-01-25"), ("7d", "previous", "2024-01-11", "2024-01-18")]))
def _(spark, d):
    """Every preset and the period before it, counted in one scan."""
    spans = {}
    for n in ("today", "week", "month", "7d"):
        spans[n, "current"] = timeutil.preset(n, _AT, SEOUL)
        spans[n, "previous"] = timeutil.previous(spans[n, "current"], n, SEOUL)
    return periods(T.usage_events(spark, d), spans, "preset", "side")


def periods(events: DataFrame, spans: dict, *names: str) -> DataFrame:
    """Events in each of a few periods, which may overlap: conditional counts of one scan, then a row each."""
    n = [F.count_if((F.col("ts") >= F.lit(p.start)) & (F.col("ts") < F.lit(p.end))).alias(f"c{i}") for i, p in enumerate(spans.values())]
    return events.agg(*n).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, key)], F.col(f"c{i}").alias("events")) for i, key in enumerate(spans)])))


@query("tim6_clamped_period", f"WITH {T.EV} SELECT count(*) AS events FROM ev WHERE ts >= timezone('UTC', timezone('{YORK}', TIMESTAMP '2024-01-18')) AND ts < TIMESTAMP '2024-01-25'")
def _(spark, d):
    """The last seven local days (up to Jan 24, 19:00 in New York) of a long period."""
    p = timeutil.clamped(timeutil.Period(datetime(2020, 1, 1, tzinfo=UTC), datetime(2024, 1, 25, tzinfo=UTC)), YORK, 7)
    return T.usage_events(spark, d).where((F.col("ts") >= F.lit(p.start)) & (F.col("ts") < F.lit(p.end))).agg(F.count(F.lit(1)).alias("events"))


@query("tim7_insight_pairs", f"WITH {T.EV} " + " UNION ALL ".join(f"SELECT '{n}' AS preset, '{s}' AS side, count(*) AS events FROM ev WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}'" for n, s, a, b in [("7", "current", "2024-01-17 12:30", "2024-01-24 12:30"), ("7", "previous", "2024-01-10 12:30", "2024-01-17 12:30"), ("week", "current", "2024-01-20 15:00", "2024-01-24 12:30"), ("week", "previous", "2024-01-13 15:00", "2024-01-17 12:30"), ("month", "current", "2023-12-31 15:00", "2024-01-24 12:30"), ("month", "previous", "2023-11-30 15:00", "2023-12-24 12:30")]))
def _(spark, d):
    spans = {(n, s): p for n in ("7", "week", "month") for s, p in zip(("current", "previous"), timeutil.insight_pair(n, SEOUL, timeutil.anchor(_AT)))}
    return periods(T.usage_events(spark, d), spans, "preset", "side")


@query("src6_zone_cache", f"{BASE} SELECT {M} FROM p")
def _(spark, d):
    """Head and tail from raw events, whole local days between them from a rollup of the zone."""
    e = T.usage_events(spark, d)
    first, last = timeutil.first_instant(date(2024, 1, 16), SEOUL), timeutil.first_instant(date(2024, 1, 24), SEOUL)
    days = rollup.local_rollup(rollup.compact(e), SEOUL).where((F.col("bucket") >= "2024-01-16") & (F.col("bucket") < "2024-01-24"))
    raw = lambda a, b: e.where((F.col("ts") >= a) & (F.col("ts") < b)).withColumn("cost_usd", F.col("cost_usd").cast("decimal(28,8)"))
    at = lambda x: F.lit(x).cast("timestamp")
    cols = [*rollup.DIMENSIONS, *rollup.SUMS, "cost_usd"]
    parts = [raw(at(SCOPE.start), F.lit(first)), days.withColumn("cost_usd", F.col("cost_usd").cast("decimal(28,8)")), raw(F.lit(last), at(SCOPE.end))]
    return usage.overview(parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols)))


@query("str4_dirty_fence", f"{BASE} SELECT provider_key, {M} FROM p GROUP BY 1")
def _(spark, d):
    """A bucket within the period is dirty: the rollup is read up to it, raw events from there on; the rest of the rollup is wrong."""
    e = T.usage_events(spark, d)
    bad = datetime(2024, 1, 19, 6, 15, tzinfo=UTC)
    stale = rollup.compact(e.where((F.col("ts") < F.lit(bad)) | (F.col("event_id") % 2 == 0)))
    p = rollup.plan(datetime(2024, 1, 15, tzinfo=UTC), datetime(2024, 1, 25, tzinfo=UTC), datetime(2024, 1, 30, tzinfo=UTC), [bad])
    return usage.breakdown(rollup.stitched(e, stale, p), "provider_key")


@query("str5_ready_prefix", "WITH b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-10 23:45', INTERVAL 15 MINUTE)) AS ts) SELECT ts FROM b WHERE ts < TIMESTAMP '2024-01-10 11:30'")
def _(spark, d):
    buckets = spark.sql("SELECT explode(sequence(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-10 23:45', INTERVAL 15 MINUTES)) AS ts")
    covered = buckets.where("ts <> TIMESTAMP '2024-01-10 18:00'")
    dirty = buckets.where("ts = TIMESTAMP '2024-01-10 11:30'")
    return rollup.ready_prefix(buckets, covered, dirty).select(F.col("ts").cast("timestamp_ntz").alias("ts"))


_EDGES = "s AS (SELECT c_custkey AS id, TIMESTAMP '2024-01-10' + to_days(c_custkey % 5) AS a, TIMESTAMP '2024-01-10' + to_days(c_custkey % 5 + c_custkey % 4) + to_minutes(15 * (c_custkey % 90)) AS b, CASE WHEN c_custkey % 11 <> 0 THEN TIMESTAMP '2024-01-10' + to_minutes(15 * (c_custkey % 700)) END AS w, c_custkey % 4 * 0.5::DOUBLE AS pace FROM customer)"


@query("agg36_rollup_progress", f"""WITH {_EDGES}, q AS (SELECT *, (date_diff('minute', a, b) + 14) // 15 AS total, CASE WHEN w IS NULL THEN a ELSE least(b, greatest(a, w)) END AS edge FROM s),
r AS (SELECT *, greatest(0, date_diff('minute', edge, b) // 15) AS ahead FROM q), e AS (SELECT DISTINCT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket FROM events),
n AS (SELECT id, count(bucket) AS again FROM r LEFT JOIN e ON user_id = id AND bucket >= a AND bucket < b AND NOT (date_diff('minute', edge, bucket) % 15 = 0 AND bucket >= edge AND date_diff('minute', edge, bucket) // 15 < ahead) GROUP BY 1)
SELECT id, CASE WHEN total > 0 THEN floor(1000 * greatest(0, total - ahead) / total + 0.5) / 10 ELSE 100.0 END::DOUBLE AS percent, greatest(0, total - ahead)::BIGINT AS completed, total::BIGINT AS total, (ahead + again)::BIGINT AS remaining, CASE WHEN ahead + again = 0 THEN 0 WHEN pace > 0 THEN ceil((ahead + again) / pace) END::BIGINT AS eta_minutes FROM r JOIN n USING (id)""")
def _(spark, d):
    """The progress of many coordinators, each with its range, watermark and pace; a user's events make its buckets dirty."""
    k, at = F.col("c_custkey"), F.lit("2024-01-10").cast("timestamp")
    state = table(spark, d, "customer").select(
        k.alias("id"),
        (at + F.make_dt_interval((k % 5).cast("int"))).alias("start"),
        (at + F.make_dt_interval((k % 5 + k % 4).cast("int"), mins=(k % 90 * 15).cast("int"))).alias("end"),
        F.when(k % 11 != 0, at + F.make_dt_interval(mins=(k % 700 * 15).cast("int"))).alias("watermark"),
        (k % 4 * F.lit(0.5)).alias("per_minute"),
    )
    dirty = T.usage_events(spark, d).select(F.col("user_id").alias("id"), X.bucket_start("ts").alias("bucket"))
    return jobs.progress_of(state, dirty)


@query("alg2_cost_modes", f"WITH {T.EV} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN cost_usd::DOUBLE ELSE 0 END AS display, CASE WHEN event_id % 2 = 0 THEN cost_usd::DOUBLE WHEN event_id % 3 = 0 THEN 1.5 ELSE 0 END AS auto, CASE WHEN event_id % 3 = 0 THEN 1.5 ELSE 0 END::DOUBLE AS calculate FROM ev")
def _(spark, d):
    given = F.when(F.col("event_id") % 2 == 0, F.col("cost_usd").cast("double"))
    computed = F.when(F.col("event_id") % 3 == 0, F.lit(1.5))
    return T.usage_events(spark, d).select("event_id", *[pricing.cost_by_mode(m, given, computed).alias(m) for m in pricing.MODES])


@query("alg3_pricing_models", f"""WITH {T.EV}, x AS (SELECT *, (ts + to_days((event_id % 900)::INT))::DATE AS day, CASE WHEN event_id % 3 = 0 THEN 'codex-auto-review' ELSE model END AS said FROM ev)
SELECT event_id, CASE WHEN said = 'codex-auto-review' THEN CASE WHEN day >= DATE '2026-04-23' THEN 'gpt-5.5' WHEN day >= DATE '2026-03-05' THEN 'gpt-5.4' WHEN day >= DATE '2026-02-05' THEN 'gpt-5.3-codex' WHEN day >= DATE '2025-12-11' THEN 'gpt-5.2-codex' WHEN day >= DATE '2025-11-13' THEN 'gpt-5.1-codex' WHEN day >= DATE '2025-09-15' THEN 'gpt-5-codex' ELSE 'gpt-5' END
 WHEN said IS NULL AND provider_key = 'click' THEN 'gpt-5' ELSE said END AS model FROM x""")
def _(spark, d):
    e = T.usage_events(spark, d)
    at = F.col("ts") + F.make_dt_interval((F.col("event_id") % 900).cast("int"))
    said = F.when(F.col("event_id") % 3 == 0, pricing.REVIEW).otherwise(F.col("model"))
    source = F.when(F.col("provider_key") == "click", "codex").otherwise(F.col("provider_key"))
    return e.select("event_id", pricing.pricing_model(said, at, source, source).alias("model"))


@query("alg7_dedup_keys", f"""WITH {T.EV}, x AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END AS id, epoch_us(ts) // 1000 AS ms, concat_ws('|', input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens) AS n FROM ev)
SELECT event_id, sha256(CASE WHEN id IS NOT NULL THEN concat_ws('|', 'req', id, coalesce(model, ''), n) ELSE concat_ws('|', 'nat', coalesce(session_id, ''), '', ms, n) END) AS server_key,
 sha256(CASE WHEN id IS NOT NULL THEN concat_ws(':', 'files', id, coalesce(model, ''), replace(n, '|', ':')) ELSE concat_ws(':', 'files', coalesce(session_id, ''), ms, coalesce(model, ''), input_tokens, output_tokens) END) AS collector_key FROM x""")
def _(spark, d):
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string")))
    e = T.usage_events(spark, d).withColumns({"request_id": said, "message_id": said, "sequence": F.lit(None).cast("long"), "ts_ms": F.unix_millis("ts")})
    return e.select("event_id", X.dedup_key().alias("server_key"), X.collector_key(F.lit("files")).alias("collector_key"))


@query("alg16_percent_delta", "SELECT p_partkey AS item, CASE WHEN p_size % 5 > 0 THEN nullif(greatest(-999, least(999, floor((p_partkey - p_size % 5) / (p_size % 5) * 100 + 0.5))), 0)::BIGINT END AS delta FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), X.percent_delta(F.col("p_partkey"), F.col("p_size") % 5).alias("delta"))


@query("alg17_others_series", f"""{BASE}, m AS (SELECT user_id FROM p GROUP BY 1 ORDER BY sum(tokens) DESC, user_id LIMIT 3), d AS (SELECT {label(SEOUL)} AS bucket, user_id, sum(tokens) AS tokens FROM p GROUP BY 1, 2)
SELECT bucket, m.user_id AS member, coalesce(sum(d.tokens) FILTER (WHERE d.user_id = m.user_id), 0)::BIGINT AS tokens FROM d, m GROUP BY 1, 2 UNION ALL SELECT bucket, NULL, coalesce(sum(tokens) FILTER (WHERE user_id NOT IN (SELECT user_id FROM m)), 0)::BIGINT FROM d GROUP BY 1""")
def _(spark, d):
    return usage.members_and_others(ev(spark, d), SEOUL, 3)


@query("alg18_shares", f"{BASE}, u AS (SELECT user_id, sum(tokens)::BIGINT AS tokens FROM p GROUP BY 1) SELECT user_id, floor(tokens / sum(tokens) OVER () * 100 + 0.5)::BIGINT AS share, greatest(3, floor(tokens / max(tokens) OVER () * 100 + 0.5))::BIGINT AS width FROM u")
def _(spark, d):
    u = ev(spark, d).groupBy("user_id").agg(F.sum(X.total_tokens()).cast("long").alias("tokens"))
    t = u.agg(F.sum("tokens").alias("whole"), F.max("tokens").alias("largest"))
    return u.crossJoin(F.broadcast(t)).select("user_id", X.share_percent(F.col("tokens"), F.col("whole")).alias("share"), X.bar_width(F.col("tokens"), F.col("largest")).alias("width"))


@query("alg20_withdrawal", "SELECT event_id FROM events WHERE NOT (user_id = 7 AND event_type = 'view' AND event_id % 2 = 0)")
def _(spark, d):
    """Listed keys of one owner and provider go; a listed key of another stays."""
    e = T.usage_events(spark, d)
    listed = e.where("event_id % 2 = 0").select("dedup_key", F.lit(7).cast("long").alias("user_id"), F.lit("view").alias("provider_key"))
    return ingest.without_keys(e, listed, ["dedup_key", "user_id", "provider_key"]).select("event_id")


@query("alg26_price_history", "WITH s AS (SELECT p_brand AS model_id, min(p_size) AS first FROM part GROUP BY 1) SELECT model_id, TIMESTAMP '2023-06-01' AS valid_from FROM s")
def _(spark, d):
    """Prices that never change have one stretch, from the start of the range."""
    s = table(spark, d, "part").select(F.col("p_brand").alias("model_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("p_size") * 86400).alias("observed_at"), F.lit(1.0).alias("input"), F.lit(2.0).alias("output")).distinct()
    return repair.history_intervals(s, "2023-06-01").select("model_id", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"))


@query("alg27_history_previews", f"{_TURNS}, g AS (SELECT session, arg_min(text, (role <> 'user', turn)) AS text FROM t GROUP BY 1), c AS (SELECT session, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM g) SELECT session, CASE WHEN length(line) > 40 THEN substr(line, 1, 40) || '…' ELSE line END AS preview FROM c")
def _(spark, d):
    """Previews of requests that come after a marker and between attachments."""
    t = turns(spark, d).withColumn("text", F.concat(F.lit("## Files mentioned by the user:\n## codex-clipboard-1.png\n## My request for assistant:\n"), F.col("text"), F.lit('<image src="a">x</image>')))
    pick = F.min_by("text", F.struct((F.col("role") != "user").alias("a"), "turn"))
    return t.groupBy("session").agg(pick.alias("text")).select("session", history.cleaned(F.col("text"), 40).alias("preview"))


@query("alg5_finalised_events", "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN 'h' || (user_id % 4) END AS host FROM events WHERE ts >= TIMESTAMP '2024-04-18 12:00' - INTERVAL 90 DAY")
def _(spark, d):
    e = T.usage_events(spark, d).withColumn("host", F.concat(F.lit("\t "), F.col("host"), F.lit(" \x7f")))
    return pricing.finalised(e, "2024-04-18 12:00").select("event_id", "host")


@query("alg8_utilization_anchors", f"""WITH {T.EV}, d AS (SELECT DISTINCT user_id, {label(SEOUL)}::DATE AS day FROM ev), a AS (SELECT unnest(range(12))::INT AS week)
SELECT week, count(*) FILTER (WHERE day >= DATE '2024-02-01' - (week * 7 + 7) AND day < DATE '2024-02-01' - week * 7) AS current_days, count(*) FILTER (WHERE day >= DATE '2024-02-01' - (week * 7 + 35) AND day < DATE '2024-02-01' - (week * 7 + 7)) AS baseline_days FROM a, d GROUP BY 1""")
def _(spark, d):
    """Active days of the last 7 local days and of the 28 before, at twelve weekly anchors, from one scan."""
    days = T.usage_events(spark, d).select("user_id", F.to_date(X.local("ts", SEOUL)).alias("day")).distinct()
    spans = {(w, s): timeutil.utilization_periods(date(2024, 2, 1) - timedelta(days=7 * w), "UTC")[k] for w in range(12) for k, s in enumerate(("current", "baseline"))}
    within = lambda p: (F.col("day") >= F.lit(p.start.date())) & (F.col("day") < F.lit(p.end.date()))
    n = days.agg(*[F.count_if(within(p)).alias(f"{s}{w}") for (w, s), p in spans.items()])
    return n.select(F.inline(F.array(*[F.struct(F.lit(w).alias("week"), F.col(f"current{w}").alias("current_days"), F.col(f"baseline{w}").alias("baseline_days")) for w in range(12)])))


@query("alg11_baseline_scores", """WITH b AS (SELECT l_suppkey AS k, list(l_discount) AS l, median(l_discount) AS m, max(l_tax) AS cur FROM lineitem GROUP BY 1), s AS (SELECT k, m, cur, list_median(list_transform(l, lambda x: abs(x - m))) AS mad FROM b)
SELECT k AS supplier, greatest(0, least(100, floor(0.5 + 50 + 15 * ((cur - m) / greatest(1.4826 * mad, 0.05)))))::BIGINT AS score FROM s""")
def _(spark, d):
    scores = tools.baseline_scores(table(spark, d, "lineitem"), "l_suppkey", "l_discount", "l_tax")
    return scores.withColumnRenamed("l_suppkey", "supplier")


@query("jn11_stale_rollup", f"{BASE}, r AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, count(*) AS raw, count(*) FILTER (WHERE event_id % 100 <> 0) AS kept FROM p GROUP BY 1) SELECT bucket, raw - kept AS missing FROM r WHERE raw <> kept")
def _(spark, d):
    """Buckets of which the rollup lacks events: raw counts to the left, those of the rollup or none."""
    e = ev(spark, d)
    n = lambda df, c: df.groupBy(X.bucket_start("ts").alias("bucket")).agg(F.sum("event_count").alias(c))
    met = n(e, "raw").join(n(rollup.compact(e.where("event_id % 100 <> 0")), "kept"), "bucket", "left")
    return met.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), (F.col("raw") - F.coalesce("kept", F.lit(0))).alias("missing")).where("missing <> 0")


@query("agg27_having_page", f"{_TURNS} SELECT session, max(turn) AS last_turn FROM t GROUP BY 1 HAVING (max(turn), session) < (3, 40) ORDER BY last_turn DESC, session DESC LIMIT 21")
def _(spark, d):
    """A page after (3, 40), by what only the grouping knows."""
    return history.page(history.groups(turns(spark, d)), (3, 40), 20).select("session", "last_turn")


@query("str3_tick_buckets", """WITH x AS (SELECT unnest([TIMESTAMP '2024-01-02 00:00', TIMESTAMP '2024-01-03 00:00']) AS bucket UNION ALL SELECT unnest(generate_series(TIMESTAMP '2024-01-10 00:00', TIMESTAMP '2024-01-10 01:15', INTERVAL 15 MINUTE)))
SELECT bucket, (SELECT count(*) FROM events WHERE ts >= bucket AND ts < bucket + INTERVAL 15 MINUTE) AS events FROM x""")
def _(spark, d):
    """A tick of eight: dirty buckets first, then on from the watermark, no later than half an hour ago."""
    at = lambda *x: datetime(2024, 1, *x, tzinfo=UTC)
    todo = rollup.next_buckets(at(10), [at(3), at(2)], at(10, 6), batch=8)
    buckets = spark.createDataFrame([(b,) for b in todo], "bucket timestamp")
    e = T.usage_events(spark, d).select(X.bucket_start("ts").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("events"))
    return buckets.join(e, "bucket", "left").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), F.coalesce("events", F.lit(0)).alias("events"))


@query("str7_prewarm_windows", f"""WITH z AS (SELECT n_nationkey AS id, {_ZONED.replace("n %", "n_nationkey %")} AS zone, DATE '2024-01-10' + (n_nationkey * 13)::INT AS today FROM nation), i AS (SELECT *, unnest([399, 31, -1]) AS back FROM z),
j AS (SELECT id, back, timezone('UTC', timezone(zone, (today - back::INT)::TIMESTAMP)) AS moment FROM i), p AS (SELECT id, max(moment) FILTER (WHERE back = 399) AS a, max(moment) FILTER (WHERE back = 31) AS h, max(moment) FILTER (WHERE back = -1) AS b FROM j GROUP BY 1)
SELECT id, 'day' AS unit, 25::BIGINT AS windows, a AS first_from, b AS last_to FROM p UNION ALL SELECT id, 'hour', ceil(date_diff('minute', h, b) / 960.0)::BIGINT, h, b FROM p""")
def _(spark, d):
    """Windows of many zones and days, over changes of clocks: 25 chunks of days and as many of hours as the last days have."""
    n = F.col("n_nationkey")
    at = table(spark, d, "nation").select(n.alias("id"), zone_of(n).alias("zone"), F.date_add(F.lit("2024-01-10").cast("date"), (n * 13).cast("int")).alias("today"))
    w = jobs.prewarm_windows(at)
    return w.groupBy("id", "unit").agg(F.count(F.lit(1)).alias("windows"), F.min("start").alias("first_from"), F.max("end").alias("last_to"))


@query("str14_read_fence", "SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_custkey % 24 < 12 AND c_custkey % 24 + c_custkey % 3 + 1 > 6")
def _(spark, d):
    """Users whose period of replacement overlaps the half-open period asked for, hours 6 to 12 of a day."""
    h = F.col("c_custkey") % 24
    busy = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), h.alias("a"), (h + F.col("c_custkey") % 3 + 1).alias("b"))
    return busy.where((F.col("a") < 12) & (F.col("b") > 6)).select("user_id")


@query("src16_plain_transcripts", "WITH t AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, CASE role WHEN 'user' THEN role ELSE 'assistant' END AS role, trim(translate(coalesce(text, ''), ':[', ';('), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations) SELECT * FROM t WHERE text <> ''")
def _(spark, d):
    """Conversations written as plain text, without signs that marks have, a tool's call and result after each turn, and read back."""
    c = table(spark, d, "conversations")
    mark = F.when(F.col("role") == "user", "user: ").otherwise("A: ")
    text = F.concat(mark, F.translate(F.coalesce("text", F.lit("")), ":[", ";("), F.lit("\n[Tool call] mcp__docs__find(x)\n[Tool result] hidden"))
    files = c.groupBy(F.col("conv_id").cast("string").alias("file")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", text.alias("x")))), lambda t: t["x"]), "\n").alias("value"))
    return logs.plain_turns(files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value"))).select(F.col("file").cast("long").alias("session"), "turn", "role", "text")


_JOBS = """j AS (SELECT o_orderkey AS id, date_trunc('day', o_orderdate) AS a, date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS b, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'pending' END AS state, TIMESTAMP '2024-01-01 12:00' - to_minutes(o_orderkey % 10) AS u FROM orders),
e AS (SELECT *, b <= TIMESTAMP '1997-01-01' AND dayofmonth(a) <> 5 AS ready FROM j WHERE state = 'pending' OR (state = 'running' AND u < TIMESTAMP '2024-01-01 11:55'))"""


def day_jobs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Jobs of a day each, and a dirty bucket on the fifth of every month."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    state = F.when(k % 4 == 1, "running").when(k % 4 == 2, "done").otherwise("pending")
    at = F.lit("2024-01-01 12:00").cast("timestamp")
    rows = o.select(k.alias("id"), day.alias("source_from"), (day + F.make_dt_interval(F.lit(1))).alias("source_to"), state.alias("state"), (at - F.make_dt_interval(mins=(k % 10).cast("int"))).alias("updated_at"), F.lit(0).alias("created_at"), (k % 3).alias("generation"))
    return rows, rows.select((F.col("source_from") + F.make_dt_interval(hours=F.lit(7))).alias("bucket")).where("dayofmonth(bucket) = 5").distinct()


_CLOCK, _MARK = datetime(2024, 1, 1, 12, tzinfo=UTC), datetime(1997, 1, 1, tzinfo=UTC)


@query("str8_job_claim", f"WITH {_JOBS} SELECT id FROM e WHERE ready ORDER BY id LIMIT 50")
def _(spark, d):
    rows, dirty = day_jobs(spark, d)
    return jobs.claimed(rows, dirty, _MARK, _CLOCK, 50).where("claimed").select("id")


@query("str8_job_waiting", f"WITH {_JOBS} SELECT count(*) FILTER (WHERE ready) AS eligible, count(*) FILTER (WHERE NOT ready) AS waiting FROM e")
def _(spark, d):
    rows, dirty = day_jobs(spark, d)
    return jobs.waiting_counts(rows, dirty, _MARK, _CLOCK)


@query("str8_job_completion", f"WITH {_JOBS} SELECT id, CASE WHEN state = 'running' AND id % 5 = 0 THEN 'pending' WHEN state = 'running' AND id % 5 <> 1 AND b <= TIMESTAMP '1997-01-01' AND dayofmonth(a) <> 5 THEN 'done' ELSE state END AS state FROM j")
def _(spark, d):
    """Every fifth job failed, and every fifth was invalidated meanwhile."""
    rows, dirty = day_jobs(spark, d)
    results = rows.select("id", F.when(F.col("id") % 5 == 1, -1).otherwise(F.col("generation")).alias("generation"), (F.col("id") % 5 != 0).alias("ok"))
    return jobs.completed(rows, results, dirty, _MARK, _CLOCK).select("id", "state")
