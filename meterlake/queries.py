"""Named queries over the driver's tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import compare, history, ingest, pricing, tools, usage
from .plans import rollup
from .sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
START, END, BEFORE = "2024-01-15", "2024-01-25", "2024-01-05"
SEOUL, YORK = "Asia/Seoul", "America/New_York"
SCOPE, PREVIOUS = usage.Scope(START, END), usage.Scope(BEFORE, START)
CAPABLE = ["click", "view", "purchase"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def label(zone: str, form: str = "%Y-%m-%d") -> str:
    return f"strftime(timezone('{zone}', timezone('UTC', ts)), '{form}')"


PERIOD = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"
COST = "round(coalesce(sum(cost_usd) FILTER (WHERE cost_status <> 'unpriced'), 0)::DOUBLE, 4) AS cost"
TOKENS = ", ".join(f"coalesce(sum({x}_tokens), 0)::BIGINT AS {x}_tokens" for x in ("input", "output", "cache_read", "cache_creation"))
COVER = ", ".join(f"count(*) FILTER (WHERE cost_status = '{s}') AS {s}_events" for s in ("priced", "unpriced", "legacy"))
SHORT = f"count(DISTINCT session_id) AS sessions, count(DISTINCT user_id) AS active_users, {COST}, {TOKENS}"
M = f"{SHORT}, {COVER}"
BASE = f"WITH {T.EV}, p AS (SELECT * FROM ev WHERE {PERIOD})"
TEAMED = f"WITH {T.EV}, t AS (SELECT *, {T.TEAM} AS team_id FROM ev), p AS (SELECT * FROM t WHERE {PERIOD})"


def ev(spark, d, scope: usage.Scope = SCOPE) -> DataFrame:
    return usage.scan(T.usage_events(spark, d), scope)


def teamed(spark, d) -> DataFrame:
    return ingest.attributed(T.usage_events(spark, d), T.assignments(spark, d))


# Sources and filters


@query("src1_raw_scan", f"{BASE} SELECT dedup_key, provider_key, user_id, session_id, model, host, ts, input_tokens, cost_status FROM p WHERE provider_key = 'click'")
def _(spark, d):
    e = usage.scan(T.usage_events(spark, d), usage.Scope(START, END, provider="click"))
    return e.select("dedup_key", "provider_key", "user_id", "session_id", "model", "host", F.col("ts").cast("timestamp_ntz").alias("ts"), "input_tokens", "cost_status")


@query("src2_last_version", f"WITH {T.EV} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'priced' ELSE cost_status END AS cost_status, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM ev")
def _(spark, d):
    e = T.usage_events(spark, d).select("dedup_key", "event_id", "cost_status").withColumn("version", F.lit(1))
    again = e.where("event_id % 3 = 0").withColumn("cost_status", F.lit("priced")).withColumn("version", F.lit(2))
    return ingest.latest(e.unionByName(again)).select("event_id", "cost_status", "version")


@query("src22_storage_stats", "SELECT 'events' AS name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events UNION ALL SELECT 'conversations', count(*), NULL, NULL FROM conversations")
def _(spark, d):
    a = T.table(spark, d, "events").agg(F.lit("events").alias("name"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    none = F.lit(None).cast("timestamp_ntz")
    return a.unionByName(T.table(spark, d, "conversations").agg(F.lit("conversations").alias("name"), F.count(F.lit(1)).alias("n"), none.alias("first_ts"), none.alias("last_ts")))


@query("flt1_scoped_period", f"{TEAMED} SELECT {M} FROM p WHERE provider_key = 'view' AND team_id = 3 AND user_id IN (3, 28, 53, 78, 121)")
def _(spark, d):
    return usage.overview(usage.scan(teamed(spark, d), usage.Scope(START, END, "view", team=3, users=(3, 28, 53, 78, 121))))


@query("flt2_provider_gate", f"WITH {T.EV} SELECT provider_key, count(*) AS events FROM ev WHERE provider_key IN ('click', 'view', 'error') GROUP BY ALL")
def _(spark, d):
    providers = spark.sql("SELECT * FROM VALUES ('click', 'logfile'), ('view', 'logfile'), ('error', 'logfile'), ('signup', 'otel') AS p(provider_key, method)")
    gate = providers.where("method = 'logfile'").select("provider_key")
    return T.usage_events(spark, d).join(gate, "provider_key", "left_semi").groupBy("provider_key").agg(F.count(F.lit(1)).alias("events"))


@query("flt6_expiry", f"WITH {T.EV} SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS kept, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20') AS expired FROM ev")
def _(spark, d):
    old = F.col("ts") >= F.lit("2024-04-19").cast("timestamp") - F.make_dt_interval(F.lit(90))
    return T.usage_events(spark, d).agg(F.count_if(old).alias("kept"), F.count_if(~old).alias("expired"))


@query("flt8_clean_host", "SELECT event_id, nullif(trim('h' || (user_id % 4)), '') AS host FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0")
def _(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("\t h"), (F.col("user_id") % 4).cast("string"), F.lit("  ")))
    return T.table(spark, d, "events").select("event_id", X.clean_host(raw).alias("host"))


@query("flt13_bucket_membership", f"WITH {T.EV}, b AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM ev WHERE event_id % 500 = 0) SELECT event_id FROM ev WHERE time_bucket(INTERVAL 15 MINUTE, ts) IN (SELECT b FROM b)")
def _(spark, d):
    e = T.usage_events(spark, d)
    dirty = ingest.dirty_buckets(e.where("event_id % 500 = 0"))
    return e.withColumn("bucket", X.bucket_start("ts")).join(dirty, "bucket", "left_semi").select("event_id")


# Aggregates


@query("agg1_overview", f"{BASE} SELECT {M} FROM p")
def _(spark, d):
    return usage.overview(ev(spark, d))


@query("agg2_daily_series", f"{BASE} SELECT {label(SEOUL)} AS bucket, {SHORT} FROM p GROUP BY 1")
def daily_series(spark, d):
    return usage.series(ev(spark, d), SEOUL)


@query("agg3_member_series", f"{BASE} SELECT {label(YORK)} AS bucket, user_id, {SHORT} FROM p WHERE user_id IN (1, 2, 3, 40) GROUP BY 1, 2")
def _(spark, d):
    return usage.series(ev(spark, d, usage.Scope(START, END, users=(1, 2, 3, 40))), YORK, "day", "user_id")


@query("agg4_models", f"{BASE} SELECT coalesce(model, '(unknown)') AS model, {M} FROM p GROUP BY 1")
def _(spark, d):
    return usage.breakdown(ev(spark, d), "model", "(unknown)")


@query("agg5_providers", f"{BASE} SELECT provider_key, {M} FROM p GROUP BY 1")
def _(spark, d):
    return usage.breakdown(ev(spark, d), "provider_key")


@query("agg6_hosts", f"{BASE} SELECT host, {M} FROM p GROUP BY 1")
def _(spark, d):
    return usage.breakdown(ev(spark, d), "host")


@query("agg7_model_series", f"{BASE} SELECT {label(SEOUL)} AS bucket, coalesce(model, '(unknown)') AS model, {COST}, sum(tokens)::BIGINT AS tokens FROM p GROUP BY 1, 2")
def _(spark, d):
    return usage.bucket_by(ev(spark, d), SEOUL, "day", "model", "(unknown)")


@query("agg8_hourly_series", f"{BASE} SELECT {label(YORK, '%Y-%m-%d %H:00')} AS bucket, {SHORT} FROM p WHERE user_id = 5 GROUP BY 1")
def _(spark, d):
    return usage.series(ev(spark, d, usage.Scope(START, END, user=5)), YORK, "hour")


@query("tim2_half_hours", f"{BASE} SELECT strftime(timezone('Asia/Kathmandu', timezone('UTC', ts)), '%Y-%m-%d %H:') || lpad(((minute(timezone('Asia/Kathmandu', timezone('UTC', ts))) // 30) * 30)::VARCHAR, 2, '0') AS bucket, {SHORT} FROM p GROUP BY 1")
def _(spark, d):
    return usage.series(ev(spark, d), "Asia/Kathmandu", "30m")


_LEAD = f"count(DISTINCT session_id) AS sessions, {COST}, sum(tokens)::BIGINT AS tokens, {COVER}"


@query("agg9_user_leaderboard", f"{BASE}, s AS (SELECT user_id, {_LEAD} FROM p GROUP BY 1 ORDER BY cost DESC, user_id LIMIT 100) SELECT s.*, coalesce(c_name, user_id::VARCHAR) AS label FROM s LEFT JOIN customer ON c_custkey = user_id")
def _(spark, d):
    return usage.leaderboard(ev(spark, d), T.users(spark, d), "user_id")


@query("agg9_team_leaderboard", f"{TEAMED}, s AS (SELECT team_id, {_LEAD} FROM p WHERE team_id IS NOT NULL GROUP BY 1 ORDER BY tokens DESC, team_id LIMIT 100) SELECT s.*, coalesce(n_name, team_id::VARCHAR) AS label FROM s LEFT JOIN nation ON n_nationkey = team_id")
def _(spark, d):
    return usage.leaderboard(usage.scan(teamed(spark, d), SCOPE), T.teams(spark, d), "team_id", "tokens")


_TWO = f"WITH {T.EV}, b AS (SELECT *, CASE WHEN ts >= TIMESTAMP '{START}' THEN 'current' ELSE 'previous' END AS period FROM ev WHERE ts >= TIMESTAMP '{BEFORE}' AND ts < TIMESTAMP '{END}')"


def both(spark, d) -> DataFrame:
    return compare.tagged(T.usage_events(spark, d), SCOPE, PREVIOUS)


@query("agg11_two_period_trend", f"""{_TWO}, o AS (SELECT *, date_diff('day', CASE WHEN period = 'current' THEN DATE '{START}' ELSE DATE '{BEFORE}' END, timezone('{SEOUL}', timezone('UTC', ts))::DATE)::INT AS position FROM b)
SELECT period, position, {M} FROM o GROUP BY GROUPING SETS ((period), (period, position))""")
def _(spark, d):
    return compare.summary_and_trend(both(spark, d), SEOUL, START, BEFORE)


_PART = "".join(f", round(coalesce(sum(cost_usd) FILTER (WHERE cost_status <> 'unpriced' AND period = '{p}'), 0)::DOUBLE, 4) AS {p}_cost, coalesce(sum(tokens) FILTER (WHERE period = '{p}'), 0)::BIGINT AS {p}_tokens" for p in ("current", "previous"))
_COMP = f"SELECT 'model' AS dimension, coalesce(model, '(unknown)') AS key{_PART} FROM b GROUP BY 2 UNION ALL SELECT 'provider', provider_key{_PART} FROM b GROUP BY 2"


@query("agg12_composition", f"{_TWO} {_COMP}")
def _(spark, d):
    return compare.composition(both(spark, d))


#: Comparisons of which each shows other insights: a first period, a longer one, a shorter one, days of one user, and equal ones.
_COMPARED = {
    "first": (usage.Scope(START, END), usage.Scope("2023-11-01", "2023-12-01")),
    "longer": (usage.Scope(START, END), usage.Scope("2024-01-11", "2024-01-14")),
    "shorter": (usage.Scope("2024-01-24", END), usage.Scope("2024-01-14", "2024-01-24")),
    "user": (usage.Scope("2024-01-20", "2024-01-28", user=7), usage.Scope("2024-01-04", "2024-01-20", user=7)),
    "equal": (SCOPE, PREVIOUS),
}


def _insight_sql(name: str, current: usage.Scope, previous: usage.Scope) -> str:
    within = lambda s: f"ts >= TIMESTAMP '{s.start}' AND ts < TIMESTAMP '{s.end}'" + (f" AND user_id = {s.user}" if s.user is not None else "")
    return f"""SELECT '{name}' AS comparison, rule, name, round(score, 6) AS score FROM (WITH b AS (SELECT *, CASE WHEN {within(current)} THEN 'current' ELSE 'previous' END AS period FROM ev WHERE ({within(current)}) OR ({within(previous)})), c AS ({_COMP}),
t AS (SELECT count(DISTINCT session_id) FILTER (WHERE period = 'current') AS sc, count(DISTINCT session_id) FILTER (WHERE period = 'previous') AS sp, coalesce(sum(tokens) FILTER (WHERE period = 'current'), 0)::DOUBLE AS tc, coalesce(sum(tokens) FILTER (WHERE period = 'previous'), 0)::DOUBLE AS tp FROM b),
r AS (SELECT 'sessions' AS n, 1 AS turn, (sc - sp) / nullif(sp, 0) * 100 AS x FROM t WHERE least(sc, sp) >= 5 UNION ALL SELECT 'tokens', 2, (tc - tp) / nullif(tp, 0) * 100 FROM t WHERE least(sc, sp) >= 5),
k AS (SELECT 'usage.new' AS rule, '' AS name, 100.0::DOUBLE AS score, 0 AS turn FROM t WHERE sp = 0 AND sc > 0
 UNION ALL SELECT n || CASE WHEN x > 0 THEN '.increase' ELSE '.decrease' END, '', abs(x), turn FROM r, t WHERE abs(x) + 1e-9 >= 10
 UNION ALL SELECT 'composition.new', dimension || ':' || key, 100.0, CASE dimension WHEN 'model' THEN 3 ELSE 4 END FROM c, t WHERE sp > 0 AND previous_tokens = 0 AND current_tokens > 0
 UNION ALL SELECT CASE WHEN current_tokens / tc > previous_tokens / tp THEN 'composition.increase' ELSE 'composition.decrease' END, dimension || ':' || key, abs(current_tokens / tc - previous_tokens / tp) * 100, CASE dimension WHEN 'model' THEN 3 ELSE 4 END
 FROM c, t WHERE least(sc, sp) >= 5 AND NOT (previous_tokens = 0 AND current_tokens > 0) AND abs(current_tokens / tc - previous_tokens / tp) * 100 + 1e-9 >= 5)
SELECT * FROM k ORDER BY score DESC, turn, name LIMIT 3)"""


@query("alg14_insights", f"WITH {T.EV} " + " UNION ALL ".join(_insight_sql(n, *p) for n, p in _COMPARED.items()))
def _(spark, d):
    """The best insights of several comparisons, among them a first period, increases, decreases and shares that moved."""
    out = None
    for name, (current, previous) in _COMPARED.items():
        b = compare.tagged(T.usage_events(spark, d), current, previous)
        totals = b.groupBy("period").agg(F.countDistinct("session_id").alias("sessions"), F.sum(X.total_tokens()).cast("long").alias("tokens"))
        rows = compare.insights(totals, compare.composition(b)).select(F.lit(name).alias("comparison"), "rule", "name", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("agg10_dashboard_bundle", f"""{_TWO} SELECT 'overview' AS result_kind, period AS key, {M} FROM b GROUP BY 2
UNION ALL SELECT 'daily', {label(SEOUL)}, {M} FROM b WHERE period = 'current' GROUP BY 2 UNION ALL SELECT 'provider', provider_key, {M} FROM b WHERE period = 'current' GROUP BY 2""")
def _(spark, d):
    """One scan, and one shuffle of events: they are summed by what all three results need, and these rows are then
    grouped by each result's key."""
    by = ["provider_key", "session_id", "user_id", "cost_status"]
    sums = [*(f"{x}_tokens" for x in ("input", "output", "cache_read", "cache_creation")), "cost_usd", "event_count"]
    rows = both(spark, d).groupBy("period", X.bucket_label("ts", SEOUL).alias("day"), *by).agg(*[F.sum(c).alias(c) for c in sums])
    now = F.col("period") == "current"
    of = lambda kind, key: F.struct(F.lit(kind).alias("result_kind"), key.alias("key"))
    kinds = F.when(now, F.array(of("overview", F.col("period")), of("daily", F.col("day")), of("provider", F.col("provider_key")))).otherwise(F.array(of("overview", F.col("period"))))
    return rows.select("*", F.explode(kinds).alias("of")).groupBy("of.result_kind", "of.key").agg(*X.measures())


@query("agg13_comparison_deltas", f"{_TWO} SELECT coalesce(model, '(unknown)') AS model, sum(tokens) FILTER (WHERE period = 'current')::BIGINT AS now_tokens, sum(tokens) FILTER (WHERE period = 'previous')::BIGINT AS then_tokens, nullif(greatest(-999, least(999, floor((sum(tokens) FILTER (WHERE period = 'current') - sum(tokens) FILTER (WHERE period = 'previous'))::DOUBLE / sum(tokens) FILTER (WHERE period = 'previous') * 100 + 0.5))), 0)::BIGINT AS delta FROM b GROUP BY 1")
def _(spark, d):
    t = both(spark, d).groupBy(F.coalesce("model", F.lit("(unknown)")).alias("model")).pivot("period", ["current", "previous"]).agg(F.sum(X.total_tokens()).cast("long"))
    return t.select("model", F.col("current").alias("now_tokens"), F.col("previous").alias("then_tokens"), X.percent_delta(F.col("current"), F.col("previous")).alias("delta"))


@query("agg14_devices", f"WITH {T.EV} SELECT host, max(ts) AS last_seen, count(*) AS events FROM ev WHERE user_id = 7 GROUP BY 1")
def _(spark, d):
    return usage.devices(T.usage_events(spark, d).where("user_id = 7"))


@query("agg15_session_summaries", f"{BASE} SELECT session_id, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models, coalesce(string_agg(DISTINCT host, ',' ORDER BY host), '') AS hosts, {COST}, {TOKENS}, {COVER} FROM p WHERE session_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    return usage.session_summaries(ev(spark, d))


_CAN = "provider_key IN ('click', 'view', 'purchase')"
_UDAYS = f"""SELECT user_id, {label(SEOUL)} AS day, count(DISTINCT session_id) AS sessions, {', '.join(f"coalesce(sum({c}) FILTER (WHERE {_CAN}), 0)::BIGINT AS {c}" for c in ('input_tokens', 'cache_read_tokens', 'cache_creation_tokens'))},
count(*) FILTER (WHERE {_CAN}) AS signal_events, count(*) FILTER (WHERE NOT {_CAN}) AS unsupported_events FROM ev GROUP BY 1, 2"""


@query("agg16_utilization_days", f"WITH {T.EV} {_UDAYS}")
def _(spark, d):
    return tools.usage_days(T.usage_events(spark, d), SEOUL, CAPABLE)


_OUT = "count(*) AS calls, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}_calls" for o in ("success", "failure", "unknown"))


@query("agg17_tool_summary", f"WITH {T.TOOLS} SELECT {_OUT}, count(DISTINCT item_key) FILTER (WHERE activity_kind = 'skill') AS skills, count(DISTINCT (user_id, coalesce(host, '?'))) AS devices FROM tl")
def _(spark, d):
    return tools.summary(T.tool_events(spark, d))


@query("agg18_tool_table", f"WITH {T.TOOLS} SELECT activity_kind, item_key, {_OUT}, max(ts) AS last_seen, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM tl GROUP BY 1, 2")
def _(spark, d):
    return tools.table(T.tool_events(spark, d))


_LAG = T.TOOLS + """, lg AS (SELECT *, lag(outcome) OVER w AS was, session_id IS NOT NULL AND ts - lag(ts) OVER w <= INTERVAL 30 MINUTE AS near FROM tl WINDOW w AS (PARTITION BY user_id, session_id, activity_kind, item_key ORDER BY ts, event_id))"""
_RDAYS = f"""SELECT user_id, {label(SEOUL)} AS day, {_OUT}, count(DISTINCT item_key) AS distinct_tools, count(DISTINCT session_id) AS tool_sessions,
count(*) FILTER (WHERE near AND was = 'failure' AND outcome = 'failure') AS repeated_failures, count(*) FILTER (WHERE near AND was = 'failure' AND outcome IN ('success', 'failure')) AS recovery_attempts,
count(*) FILTER (WHERE near AND was = 'failure' AND outcome = 'success') AS recoveries FROM lg GROUP BY 1, 2"""


@query("win1_tool_recovery", f"WITH {_LAG} {_RDAYS}")
def _(spark, d):
    return tools.reliability_days(T.tool_events(spark, d), SEOUL)


def scores(spark, d) -> DataFrame:
    current, baseline = ("2024-01-23", "2024-01-30"), ("2023-12-26", "2024-01-23")
    read = lambda df, before=0: tools.of_days(df, SEOUL, baseline[0], current[1], before)
    days = tools.stacked_days(tools.usage_days(read(T.usage_events(spark, d)), SEOUL, CAPABLE), tools.reliability_days(read(T.tool_events(spark, d), tools.WINDOW_SECONDS), SEOUL))
    return tools.personal(days, current, baseline)


_SCORE = lambda k: f"greatest(0, least(100, floor(50 + 15 * ((c{k} - m{k}) / greatest(1.4826 * d{k}, 0.05)) + 0.5)))::BIGINT"
_SCORED = f"""WITH {_LAG}, u AS ({_UDAYS}), r AS ({_RDAYS}), day AS (SELECT coalesce(u.user_id, r.user_id) AS user_id, coalesce(u.day, r.day) AS day, coalesce(sessions, 0) AS sessions,
 coalesce(success_calls, 0) AS s, coalesce(failure_calls, 0) AS f, coalesce(unknown_calls, 0) AS n, coalesce(signal_events, 0) AS sig, coalesce(unsupported_events, 0) AS uns,
 CASE WHEN signal_events > 0 AND input_tokens + cache_read_tokens + cache_creation_tokens > 0 THEN cache_read_tokens / (input_tokens + cache_read_tokens + cache_creation_tokens) END AS cr,
 CASE WHEN success_calls + failure_calls > 0 THEN success_calls / (success_calls + failure_calls) END AS er FROM u FULL JOIN r ON u.user_id = r.user_id AND u.day = r.day),
z AS (SELECT *, day >= '2024-01-23' AS c FROM day WHERE day >= '2023-12-26' AND day < '2024-01-30'),
g AS (SELECT user_id, count(*) FILTER (WHERE c AND sessions > 0) AS cd, count(*) FILTER (WHERE NOT c AND sessions > 0) AS bd, coalesce(sum(sessions) FILTER (WHERE c), 0)::BIGINT AS cs,
 coalesce(sum(s + f) FILTER (WHERE c), 0) AS ck, coalesce(sum(s + f) FILTER (WHERE NOT c), 0) AS bk, coalesce(sum(s + f + n) FILTER (WHERE c), 0) AS ca, coalesce(sum(s + f + n) FILTER (WHERE NOT c), 0) AS ba,
 sum(sig) AS sg, sum(uns) AS un, count(cr) FILTER (WHERE c) AS n1, count(cr) FILTER (WHERE NOT c) AS n2, count(er) FILTER (WHERE c) AS n3, count(er) FILTER (WHERE NOT c) AS n4,
 median(cr) FILTER (WHERE c) AS c1, median(cr) FILTER (WHERE NOT c) AS m1, median(er) FILTER (WHERE c) AS c2, median(er) FILTER (WHERE NOT c) AS m2 FROM z GROUP BY 1),
a AS (SELECT z.user_id, median(abs(cr - m1)) AS d1, median(abs(er - m2)) AS d2 FROM z JOIN g USING (user_id) WHERE NOT c GROUP BY 1),
x AS (SELECT g.*, CASE WHEN sg = 0 AND un > 0 THEN 'unsupported_cache_signal' WHEN n1 < 3 OR n2 < 7 THEN 'insufficient_context_days' END AS context_reason,
 CASE WHEN ck < 10 OR bk < 10 THEN 'insufficient_known_tool_calls' WHEN ck / ca < 0.7 OR bk / ba < 0.7 THEN 'low_tool_outcome_coverage' WHEN n4 < 7 OR n3 < 2 THEN 'insufficient_tool_days' END AS execution_reason, d1, d2 FROM g LEFT JOIN a USING (user_id)),
y AS (SELECT *, CASE WHEN context_reason IS NULL THEN {_SCORE(1)} END AS context_score, CASE WHEN execution_reason IS NULL THEN {_SCORE(2)} END AS execution_score FROM x),
v AS (SELECT *, CASE WHEN cd >= 3 AND cs >= 5 AND bd >= 7 THEN floor((context_score + execution_score) / 2 + 0.5)::BIGINT END AS score FROM y),
res AS (SELECT user_id, score, CASE WHEN score IS NOT NULL AND bd >= 14 AND ck / ca >= 0.9 AND bk / ba >= 0.9 AND un / (sg + un) <= 0.1 THEN 'high' WHEN score IS NULL THEN 'low' ELSE 'medium' END AS confidence,
 context_score, execution_score, context_reason, execution_reason, concat_ws(',', CASE WHEN cd < 3 THEN 'insufficient_current_days' END, CASE WHEN cs < 5 THEN 'insufficient_current_sessions' END,
 CASE WHEN bd < 7 THEN 'insufficient_baseline_days' END, CASE WHEN context_score IS NULL OR execution_score IS NULL THEN 'insufficient_valid_dimensions' END) AS reasons, cd AS active_days, cs AS sessions FROM v)"""


@query("alg12_personal_utilization", f"{_SCORED} SELECT * FROM res")
def _(spark, d):
    return scores(spark, d)


@query("alg13_organisation_utilization", f"""{_SCORED}, o AS (SELECT count(*) FILTER (WHERE active_days > 0) AS active, count(score) AS eligible, list_sort(list(score) FILTER (WHERE score IS NOT NULL)) AS l, median(score) AS m,
 count(*) FILTER (WHERE score >= 56) AS a, count(*) FILTER (WHERE score BETWEEN 45 AND 55) AS u, count(*) FILTER (WHERE score <= 44) AS b FROM res), s AS (SELECT *, CASE WHEN active < 5 THEN 'suppressed' WHEN eligible < 5 THEN 'insufficient' ELSE 'ready' END AS state FROM o)
SELECT active, eligible, state, CASE WHEN state = 'ready' THEN m::DOUBLE END AS median, CASE WHEN state = 'ready' THEN l[floor((eligible - 1) * 0.25 + 0.5)::INT + 1] END AS p25, CASE WHEN state = 'ready' THEN l[floor((eligible - 1) * 0.75 + 0.5)::INT + 1] END AS p75,
 CASE WHEN state = 'ready' THEN a END AS above, CASE WHEN state = 'ready' THEN u END AS usual, CASE WHEN state = 'ready' THEN b END AS below FROM s""")
def _(spark, d):
    return tools.organisation(scores(spark, d))


# Rollups


@query("agg20_quarter_hours", f"WITH {T.EV} SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, provider_key, user_id, model, sum(input_tokens)::BIGINT AS input_tokens, round(sum(CASE WHEN cost_status <> 'unpriced' THEN cost_usd ELSE 0 END)::DOUBLE, 4) AS cost, count(*) AS events FROM ev GROUP BY 1, 2, 3, 4")
def _(spark, d):
    r = rollup.compact(T.usage_events(spark, d))
    return r.groupBy(F.col("ts").cast("timestamp_ntz").alias("bucket"), "provider_key", "user_id", "model").agg(F.sum("input_tokens").cast("long").alias("input_tokens"), F.round(F.sum("cost_usd").cast("double"), 4).alias("cost"), F.sum("event_count").cast("long").alias("events"))


@query("agg21_local_days", f"WITH {T.EV} SELECT {label(YORK)} AS bucket, {SHORT} FROM ev GROUP BY 1")
def _(spark, d):
    return rollup.local_rollup(rollup.compact(T.usage_events(spark, d)), YORK).groupBy("bucket").agg(*X.measures(False))


@query("src3_collapse_versions", f"WITH {T.EV} SELECT count(DISTINCT time_bucket(INTERVAL 15 MINUTE, ts)) AS buckets, count(*) AS events, sum(input_tokens)::BIGINT AS input_tokens FROM ev")
def _(spark, d):
    e = T.usage_events(spark, d)
    rows = rollup.compact(e, 1).unionByName(rollup.compact(e.where("user_id < 50").withColumn("input_tokens", F.col("input_tokens") * 0), 1).withColumn("version", F.lit(0).cast("long")))
    r = rollup.collapse(rows)
    return r.agg(F.countDistinct("ts").alias("buckets"), F.sum("event_count").cast("long").alias("events"), F.sum("input_tokens").cast("long").alias("input_tokens"))


@query("src5_stitched_series", f"WITH {T.EV}, p AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-15 03:07' AND ts < TIMESTAMP '2024-01-25') SELECT {label(SEOUL)} AS bucket, {M} FROM p GROUP BY 1")
def _(spark, d):
    e = T.usage_events(spark, d)
    at = lambda x: datetime.fromisoformat(f"{x}+00:00")
    p = rollup.plan(at("2024-01-15T03:07"), at("2024-01-25T00:00"), at("2024-01-24T00:00"), [at("2024-01-22T10:15")])
    src = rollup.stitched(e, rollup.compact(e), p)
    return src.groupBy(X.bucket_label("ts", SEOUL).alias("bucket")).agg(*X.measures())


@query("agg22_fingerprints_agree", f"WITH {T.EV}, c AS (SELECT count(*) AS rows FROM (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS b, provider_key, user_id, session_id, model, host, cost_status FROM ev)) SELECT true AS agree, (SELECT rows FROM c) AS rows, count(*) AS event_count, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM ev")
def _(spark, d):
    """The fingerprints of the raw events and of a rollup of them are the same, hash and all."""
    e = T.usage_events(spark, d)
    a, b = rollup.fingerprint(e), rollup.fingerprint(rollup.compact(e))
    both = a.select(F.struct(*a.columns).alias("a")).crossJoin(b.select(F.struct(*b.columns).alias("b")))  # a row each
    return both.select((F.col("a") == F.col("b")).alias("agree"), *[F.col(f"a.{c}").alias(c) for c in ("rows", "event_count", "input_tokens", "output_tokens")])


@query("snk6_dirty_buckets", "SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket FROM events WHERE user_id = 3")
def _(spark, d):
    return ingest.dirty_buckets(T.usage_events(spark, d).where("user_id = 3")).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"))


@query("jn10_missing_buckets", "SELECT g AS ts FROM generate_series(TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-15 23:45', INTERVAL 15 MINUTE) t(g) WHERE g NOT IN (SELECT time_bucket(INTERVAL 15 MINUTE, ts) FROM events WHERE user_id < 20)")
def _(spark, d):
    want = spark.sql("SELECT explode(sequence(timestamp'2024-01-15 00:00:00', timestamp'2024-01-15 23:45:00', interval 15 minutes)) AS ts")
    have = ingest.dirty_buckets(T.usage_events(spark, d).where("user_id < 20")).withColumnRenamed("bucket", "ts")
    return want.join(have, "ts", "left_anti").select(F.col("ts").cast("timestamp_ntz").alias("ts"))


# Ingest, pricing, attribution, repair


@query("snk1_idempotent_insert", "SELECT count(*) FILTER (WHERE event_id % 4 <> 0) AS inserted, count(*) * 2 - count(*) FILTER (WHERE event_id % 4 <> 0) AS deduped FROM events")
def _(spark, d):
    e = T.usage_events(spark, d)
    batch = e.unionByName(e)
    new = ingest.new_rows(batch, e.where("event_id % 4 = 0").select("dedup_key"))
    n = new.agg(F.count(F.lit(1)).alias("inserted"))
    return n.crossJoin(batch.agg(F.count(F.lit(1)).alias("n"))).select("inserted", (F.col("n") - F.col("inserted")).alias("deduped"))


_MART = f"SELECT {label(SEOUL)} AS day, user_id, provider_key, count(DISTINCT session_id) AS sessions, {COST}, {TOKENS}, count(*) AS events FROM ev GROUP BY 1, 2, 3"


@query("agg25_user_mart", f"WITH {T.EV} {_MART}")
def _(spark, d):
    return ingest.daily_mart(T.usage_events(spark, d), SEOUL, "user_id")


@query("agg25_team_mart", f"{TEAMED} SELECT {label(SEOUL)} AS day, team_id, provider_key, count(DISTINCT session_id) AS sessions, {COST}, {TOKENS}, count(*) AS events FROM t WHERE team_id IS NOT NULL GROUP BY 1, 2, 3")
def _(spark, d):
    return ingest.daily_mart(teamed(spark, d), SEOUL, "team_id")


@query("snk3_mart_merge", f"WITH {T.EV} SELECT user_id, provider_key, sum(input_tokens)::BIGINT AS input_tokens, count(*) AS events FROM ev GROUP BY 1, 2")
def _(spark, d):
    e = T.usage_events(spark, d)
    part = lambda p: e.where(p).groupBy("user_id", "provider_key").agg(F.sum("input_tokens").cast("long").alias("input_tokens"), F.count(F.lit(1)).alias("events"))
    return ingest.added(part("event_id % 3 <> 0"), part("event_id % 3 = 0"), ["user_id", "provider_key"], ["input_tokens", "events"])


@query("snk9_scoped_delete", f"WITH {T.EV} SELECT provider_key, count(*) AS events FROM ev WHERE NOT (user_id = 4 AND provider_key = 'view' AND event_id % 2 = 0) GROUP BY 1")
def _(spark, d):
    e = T.usage_events(spark, d)
    gone = e.where("user_id = 4 AND provider_key = 'view' AND event_id % 2 = 0").select("user_id", "provider_key", "dedup_key")
    return ingest.without_keys(e, gone, ["user_id", "provider_key", "dedup_key"]).groupBy("provider_key").agg(F.count(F.lit(1)).alias("events"))


_TWIN = f"WITH {T.EV}, z AS (SELECT * EXCLUDE (model, cost_status, event_id), NULL AS model, 'unpriced' AS cost_status, -event_id AS event_id FROM ev WHERE event_id % 20 = 3)"


@query("alg19_replay_reconciliation", f"{_TWIN} SELECT z.event_id FROM z WHERE EXISTS (SELECT 1 FROM ev WHERE ev.event_id = -z.event_id AND ev.model IS NOT NULL) OR EXISTS (SELECT 1 FROM ev e WHERE e.model IS NOT NULL AND e.user_id = z.user_id AND e.ts = z.ts AND e.host IS NOT DISTINCT FROM z.host AND e.session_id IS NOT DISTINCT FROM z.session_id AND e.input_tokens = z.input_tokens)")
def _(spark, d):
    e = T.usage_events(spark, d)
    twins = e.where("event_id % 20 = 3").withColumn("model", F.lit(None).cast("string")).withColumn("cost_status", F.lit("unpriced")).withColumn("event_id", -F.col("event_id"))
    return ingest.replayed(e.where("NOT (model IS NULL AND cost_status = 'unpriced')").unionByName(twins)).select("event_id")


@query("jn4_team_attribution", f"{TEAMED} SELECT event_id, team_id FROM t")
def _(spark, d):
    return teamed(spark, d).select("event_id", "team_id")


@query("agg23_unattributed", f"{TEAMED} SELECT count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, sum(tokens)::BIGINT AS tokens, {COST} FROM t WHERE team_id IS NULL")
def _(spark, d):
    return ingest.unattributed(teamed(spark, d))


@query("agg24_pricing_diagnostics", f"WITH {T.EV} SELECT provider_key, model, {COVER}, min(ts) AS first_ts, max(ts) AS last_ts FROM ev WHERE cost_status <> 'priced' GROUP BY 1, 2")
def _(spark, d):
    return ingest.diagnostics(T.usage_events(spark, d))


_RATE = lambda n, b, a: f"CASE WHEN {a} IS NULL OR {n} <= 200000 THEN {n} * {b} ELSE 200000 * {b} + ({n} - 200000) * {a} END / 1e6"
_ASOF = f"""WITH {T.EV}, big AS (SELECT * REPLACE (input_tokens * 2000 AS input_tokens, output_tokens * 2000 AS output_tokens) FROM ev), r AS ({T.revisions_sql()}),
j AS (SELECT big.*, r.*, row_number() OVER (PARTITION BY event_id ORDER BY effective_at DESC NULLS LAST, id DESC) AS n FROM big LEFT JOIN r ON model = model_id AND effective_at <= ts AND (valid_until IS NULL OR ts < valid_until))"""


def large(spark, d) -> DataFrame:
    return T.usage_events(spark, d).withColumn("input_tokens", F.col("input_tokens") * 2000).withColumn("output_tokens", F.col("output_tokens") * 2000)


@query("jn5_as_of_price", f"{_ASOF} SELECT event_id, id AS revision_id FROM j WHERE n = 1")
def _(spark, d):
    return pricing.as_of(large(spark, d), T.revisions(spark)).select("event_id", "revision_id")


@query("alg1_token_pricing", f"""{_ASOF} SELECT event_id, id AS revision_id, round(coalesce({_RATE('input_tokens', 'input', 'input_above')} + {_RATE('output_tokens', 'output', 'output_above')} + cache_read_tokens * coalesce(cache_read, input * 0.1) / 1e6
 + cache_creation_tokens * coalesce(cache_creation, input * 1.25) / 1e6, 0), 9) AS price, CASE WHEN id IS NULL THEN 'unpriced' ELSE 'priced' END AS status FROM j WHERE n = 1""")
def _(spark, d):
    return pricing.priced(large(spark, d), T.revisions(spark)).select("event_id", "revision_id", "price", "status")


@query("win8_price_intervals", "WITH s AS (SELECT p_brand AS model_id, TIMESTAMP '2024-01-01' + to_days((p_partkey % 40)::INT) AS observed_at, max(p_size)::DOUBLE AS input, max(p_size % 3)::DOUBLE AS output FROM part GROUP BY 1, 2), c AS (SELECT *, lag(input) OVER w AS li, lag(output) OVER w AS lo, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY model_id ORDER BY observed_at)), k AS (SELECT * FROM c WHERE n = 1 OR li <> input OR lo <> output) SELECT model_id, observed_at AS valid_from, lead(observed_at) OVER (PARTITION BY model_id ORDER BY observed_at) AS valid_until, input, output FROM k")
def _(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 40).cast("int")).cast("timestamp_ntz")
    s = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("model_id"), day.alias("observed_at")).agg(F.max("p_size").cast("double").alias("input"), F.max(F.col("p_size") % 3).cast("double").alias("output"))
    return pricing.intervals(s)


# Time, tops, history, sets


@query("tim9_gap_filled", f"{BASE}, s AS (SELECT strftime(timezone('{SEOUL}', timezone('UTC', ts)), '%Y-%m-%d %H:00') AS bucket, count(*) AS events FROM p WHERE user_id = 9 GROUP BY 1) SELECT strftime(g, '%Y-%m-%d %H:00') AS bucket, coalesce(events, 0) AS events FROM generate_series(TIMESTAMP '2024-01-15 09:00', TIMESTAMP '2024-01-25 08:00', INTERVAL 1 HOUR) t(g) LEFT JOIN s ON s.bucket = strftime(g, '%Y-%m-%d %H:00')")
def _(spark, d):
    points = ev(spark, d, usage.Scope(START, END, user=9)).groupBy(X.bucket_label("ts", SEOUL, "hour").alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
    hours = spark.sql(f"SELECT explode(sequence(timestamp'{START} 00:00:00', timestamp'{END} 00:00:00' - interval 1 hour, interval 1 hour)) AS t")
    return usage.gap_filled(points, hours.select(X.bucket_label("t", SEOUL, "hour").alias("bucket")).distinct(), ["events"])


@query("tim10_heat_map", f"{BASE}, c AS (SELECT isodow(timezone('{SEOUL}', timezone('UTC', ts)))::INT - 1 AS weekday, hour(timezone('{SEOUL}', timezone('UTC', ts)))::INT AS hour, sum(tokens)::BIGINT AS tokens FROM p GROUP BY 1, 2), v AS (SELECT list_sort(list(tokens) FILTER (WHERE tokens > 0)) AS l FROM c) SELECT weekday, hour, tokens, CASE WHEN tokens <= 0 THEN 0 WHEN tokens <= l[len(l) // 3 + 1] THEN 1 WHEN tokens <= l[2 * len(l) // 3 + 1] THEN 2 ELSE 3 END AS level FROM c, v")
def _(spark, d):
    return usage.heat_map(ev(spark, d), SEOUL)


@query("top5_models_and_other", f"{BASE}, s AS (SELECT {label(SEOUL)} AS bucket, coalesce(model, '(unknown)') AS model, sum(tokens) AS t FROM p GROUP BY 1, 2), b AS (SELECT model FROM s GROUP BY 1 ORDER BY sum(t) DESC, model LIMIT 3) SELECT bucket, CASE WHEN model IN (SELECT model FROM b) THEN model ELSE 'other' END AS model, sum(t)::BIGINT AS tokens FROM s GROUP BY 1, 2")
def _(spark, d):
    return usage.top_and_other(ev(spark, d), SEOUL)


@query("top7_peak_day", f"{BASE} SELECT {label(SEOUL)} AS bucket, sum(tokens)::BIGINT AS tokens FROM p GROUP BY 1 ORDER BY tokens DESC, bucket LIMIT 1")
def _(spark, d):
    return usage.peak(ev(spark, d).groupBy(X.bucket_label("ts", SEOUL).alias("bucket")).agg(F.sum(X.total_tokens()).cast("long").alias("tokens")), "tokens")


_TURNS = "WITH t AS (SELECT conv_id AS session, turn, role, text FROM conversations)"


def turns(spark, d) -> DataFrame:
    return T.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


_GROUPS = "SELECT session, count(*) AS turns, count(DISTINCT role) AS roles, bool_or(role = 'assistant') AS answered, min(turn) AS first_turn, max(turn) AS last_turn, substr(trim(regexp_replace(arg_min(text, (role <> 'user', turn)), '\\s+', ' ', 'g')), 1, 200) AS preview FROM t GROUP BY 1"


@query("agg26_session_groups", f"{_TURNS} {_GROUPS}")
def _(spark, d):
    return history.groups(turns(spark, d))


@query("top3_keyset_page", f"{_TURNS}, g AS ({_GROUPS}) SELECT session, last_turn, turns FROM g WHERE last_turn < 7 OR (last_turn = 7 AND session < 60) ORDER BY last_turn DESC, session DESC LIMIT 21")
def _(spark, d):
    return history.page(history.groups(turns(spark, d)), (7, 60), 20).select("session", "last_turn", "turns")


@query("alg28_history_search", f"{_TURNS} SELECT session, min(turn) AS turn FROM t WHERE contains(lower(text), 'tion') GROUP BY 1")
def _(spark, d):
    return history.search(turns(spark, d), "TION").select("session", "turn")


@query("win7_agent_runs", f"{_TURNS}, a AS (SELECT *, CASE WHEN role = 'assistant' THEN 'a' || (turn % 2) END AS agent FROM t), i AS (SELECT *, sum(CASE WHEN agent IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn) AS island FROM a) SELECT session, island::BIGINT AS island, agent, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn FROM i WHERE agent IS NOT NULL GROUP BY 1, 2, 3")
def _(spark, d):
    agent = F.when(F.col("role") == "assistant", F.concat(F.lit("a"), (F.col("turn") % 2).cast("string")))
    return history.runs(turns(spark, d).withColumn("agent", agent))


_GREEDY = """u AS (SELECT session_id AS session, event_id AS event, epoch_ms(ts) AS ms FROM ev WHERE session_id IS NOT NULL), t AS (SELECT session, event AS key, ms + 4000 AS ms, row_number() OVER (PARTITION BY session ORDER BY ms, event) AS n FROM u WHERE event % 2 = 0),
r AS (SELECT session, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS key, NULL::BIGINT AS event FROM (SELECT DISTINCT session FROM t)
UNION ALL SELECT session, n, CASE WHEN event IS NULL THEN taken ELSE list_append(taken, event) END, key, event FROM (SELECT r.session, t.n, t.key, r.taken, arg_min(u.event, (abs(u.ms - t.ms), u.ms, u.event)) FILTER (WHERE abs(u.ms - t.ms) <= 10000 AND NOT list_contains(r.taken, u.event)) AS event FROM r JOIN t ON t.session = r.session AND t.n = r.n + 1 JOIN u ON u.session = t.session GROUP BY ALL))
SELECT session, key, event FROM r WHERE event IS NOT NULL"""


@query("jn8_turn_usage_match", f"WITH RECURSIVE {T.EV}, {_GREEDY}")
def _(spark, d):
    """Turns in order, each with the nearest event of its session that none before it took, within ten seconds."""
    e = T.usage_events(spark, d).where("session_id IS NOT NULL")
    u = e.select(F.col("session_id").alias("session"), F.col("event_id").alias("event"), F.unix_millis("ts").alias("ts_ms"))
    t = e.where("event_id % 2 = 0").select(F.col("session_id").alias("session"), F.col("event_id").alias("key"), (F.unix_millis("ts") + 4000).alias("ts_ms"))
    return history.matched(t, u)


_FNV = lambda t: f"(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({t}, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 100)::INT"


@query("alg32_cohort", "SELECT c_custkey, " + _FNV("'seed:' || c_name") + " AS percent FROM customer")
def _(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", X.fnv1a_percent(F.concat(F.lit("seed:"), F.col("c_name"))).alias("percent"))


@query("alg15_coverage_state", f"{BASE}, m AS (SELECT user_id, {COVER} FROM p GROUP BY 1) SELECT user_id, CASE WHEN unpriced_events > 0 AND priced_events + legacy_events > 0 THEN 'partial' WHEN unpriced_events > 0 THEN 'unpriced' WHEN legacy_events > 0 THEN 'legacy' ELSE 'complete' END AS state FROM m")
def _(spark, d):
    m = ev(spark, d).groupBy("user_id").agg(*X.coverage())
    return m.select("user_id", X.coverage_state(F.col("priced_events"), F.col("unpriced_events"), F.col("legacy_events")).alias("state"))


@query("jn20_full_outer_audit", "SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS recomputed, b.n AS kept FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_id % 100 <> 0 OR user_id % 3 = 0 GROUP BY 1) b USING (user_id) WHERE a.n IS DISTINCT FROM b.n")
def _(spark, d):
    e = T.table(spark, d, "events")
    a = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("recomputed"))
    b = e.where("event_id % 100 <> 0 OR user_id % 3 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))
    return a.join(b, "user_id", "full").where(~F.col("recomputed").eqNullSafe(F.col("kept")))


@query("win3_latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    return T.table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("star_nation_month", "SELECT n_name AS team, strftime(l_shipdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS users, round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))::DOUBLE, 4) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2")
def _(spark, d):
    li = T.table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01' AND l_shipdate < timestamp_ntz'1996-01-01'")
    j = li.join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(T.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("team"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.countDistinct("o_custkey").alias("users"), F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double"), 4).alias("cost"))
