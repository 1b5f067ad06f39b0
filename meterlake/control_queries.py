"""Named queries on tools, rollouts, repair, jobs, sources and comparisons, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import deploy, history, ingest, repair
from .plans import jobs, rollup
from .queries import _ASOF, _FNV, _GROUPS, _RATE, _TURNS, BASE, COST, COVER, PERIOD, SCOPE, SEOUL, START, TEAMED, TOKENS, YORK, ev, label, large, query, teamed, turns
from .sources import tables as T

table = T.table

# Tools and rollouts

_TOOL_ITEMS = """items AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 2 = 0 THEN 'mcp' ELSE 'skill' END AS kind, p_brand AS item_key, 'p' || (p_size % 10) AS provider, 'v' || (p_size % 4) || '.0.0' AS source_ref FROM part),
inv AS (SELECT l_suppkey AS device, l_orderkey * 10 + l_linenumber AS position, CASE WHEN p_partkey % 2 = 0 THEN 'mcp' ELSE 'skill' END AS kind, p_brand AS item_key, CASE WHEN p_size < 20 THEN 'p' || (p_size % 10) ELSE 'elsewhere' END AS provider, CASE WHEN l_orderkey % 5 <> 0 THEN (p_size % 4) || '.0.0' END AS version FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("alg31_install_state", f"""WITH {_TOOL_ITEMS}, f AS (SELECT kind, item_key, provider, arg_min({{'v': version}}, (device, position)) AS found FROM inv GROUP BY 1, 2, 3)
SELECT item, CASE WHEN found IS NULL THEN 'not_installed' ELSE 'installed' END AS status, found.v AS version, CASE WHEN found IS NULL THEN NULL WHEN found.v IS NULL THEN 'unknown' WHEN found.v = substr(source_ref, 2) THEN 'same' ELSE 'different' END AS version_relation FROM items LEFT JOIN f USING (kind, item_key, provider)""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, "mcp").otherwise("skill").alias("kind"), F.col("p_brand").alias("item_key"), F.concat(F.lit("p"), (F.col("p_size") % 10).cast("string")).alias("provider"), F.concat((F.col("p_size") % 4).cast("string"), F.lit(".0.0")).alias("plain"))
    items = p.select(F.col("p_partkey").alias("item"), "kind", "item_key", "provider", F.concat(F.lit("v"), "plain").alias("source_ref"))
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    elsewhere = F.when(F.col("p_size") < 20, F.col("provider")).otherwise("elsewhere").alias("provider")
    inventory = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("device"), "position", "kind", "item_key", elsewhere, F.when(F.col("l_orderkey") % 5 != 0, F.col("plain")).alias("version"))
    return deploy.install_states(items, inventory).select("item", "status", "version", "version_relation")


@query("flt12_catalog", "SELECT p_partkey AS item FROM part WHERE p_size % 2 = 0 AND p_partkey % 2 = 0 AND contains(lower(p_name || chr(10) || p_type), 'st')")
def _(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.when(F.col("p_size") % 2 == 0, "public").otherwise("workspace").alias("origin"), F.when(F.col("p_partkey") % 2 == 0, "mcp").otherwise("skill").alias("kind"), (F.col("p_partkey") % 9).alias("owner_user_id"))
    return deploy.catalog_page(items, 1, "public", "mcp", " ST ").select("item")


_NOW = "2024-01-01 00:00:00"
_ROLLOUT = f"""WITH p AS (SELECT n_nationkey::BIGINT AS policy_id, n_nationkey % 4 AS version_id, CASE n_nationkey % 3 WHEN 0 THEN 'preflight' WHEN 1 THEN 'canary' ELSE 'expand' END AS phase, TIMESTAMP '{_NOW}' - to_minutes(n_nationkey * 5) AS phase_started FROM nation),
e AS (SELECT c_nationkey AS team, count(DISTINCT o_orderkey) AS eligible FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT l_partkey % 25 AS seed, l_suppkey % 4 AS version, CASE WHEN l_orderkey % 7 <> 0 THEN l_shipdate + INTERVAL 40 YEAR END AS tried, CASE WHEN l_orderkey % 900 = 0 THEN 'failed' ELSE 'installed' END AS status, (l_orderkey, l_linenumber) AS id FROM lineitem),
k AS (SELECT policy_id, phase, phase_started, eligible, count(DISTINCT id) FILTER (WHERE tried IS NOT NULL) AS attempted, count(DISTINCT id) FILTER (WHERE status = 'failed') AS failed FROM p JOIN e ON team = policy_id LEFT JOIN r ON seed = policy_id AND version = version_id AND tried >= phase_started GROUP BY ALL),
m AS (SELECT *, date_diff('minute', phase_started, TIMESTAMP '{_NOW}') AS age, failed >= 2 OR (attempted > 0 AND failed / attempted >= 0.2) AS back FROM k),
g AS (SELECT *, NOT back AND phase = 'canary' AND age >= 30 AND attempted >= greatest(1, ceil(eligible * 0.1)) AS c, NOT back AND phase = 'expand' AND age >= 60 AND attempted >= greatest(1, ceil(eligible * 0.5)) AS x FROM m)"""


def rollouts(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    policies = table(spark, d, "nation").select(n.cast("long").alias("policy_id"), n.cast("long").alias("team_id"), n.cast("long").alias("seed"), (n % 4).cast("long").alias("version_id"), F.when(n % 3 == 0, "preflight").when(n % 3 == 1, "canary").otherwise("expand").alias("phase"), F.lit(True).alias("enabled"), (F.lit(_NOW).cast("timestamp") - F.make_dt_interval(mins=n * 5)).alias("phase_started"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("team_id"))
    snapshots = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("snapshot_id"))
    o = F.col("l_orderkey")
    reports = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("report_id"), (F.col("l_partkey") % 25).alias("seed"), (F.col("l_suppkey") % 4).alias("version_id"), F.when(o % 7 != 0, (F.col("l_shipdate") + F.expr("interval 40 years")).cast("timestamp")).alias("last_attempted_at"), F.when(o % 900 == 0, "failed").otherwise("installed").alias("status"))
    return deploy.rollout_counts(policies, users, snapshots, reports)


@query("agg28_rollout_counts", f"{_ROLLOUT} SELECT policy_id, eligible, attempted, failed FROM k")
def _(spark, d):
    return rollouts(spark, d).select("policy_id", "eligible", "attempted", "failed")


@query("alg33_rollout_decision", f"{_ROLLOUT} SELECT policy_id, CASE WHEN back THEN 'rollback' WHEN c OR x THEN 'advance' ELSE 'hold' END AS action, CASE WHEN c THEN 'expand' WHEN x THEN 'active' END AS next_phase, CASE WHEN c THEN 50 WHEN x THEN 100 END AS percent FROM g")
def _(spark, d):
    return deploy.decided(rollouts(spark, d), _NOW).select("policy_id", "action", "next_phase", "percent")


_WANTED = f"""WITH dev AS (SELECT c_custkey AS user_id, 'd' || c_custkey AS fingerprint, c_nationkey AS team FROM customer),
pref AS (SELECT c_custkey AS user_id, c_custkey % 5 AS item, CASE WHEN c_custkey % 6 = 0 THEN 'exclude' ELSE 'install' END AS mode, CASE WHEN c_custkey % 4 = 0 THEN 'all_devices' ELSE 'selected' END AS scope, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 11 END AS version_id FROM customer),
pol AS (SELECT n_nationkey AS team, (n_nationkey + j) % 5 AS item, 100 + j AS version_id, 's' || n_nationkey AS seed, n_nationkey * 4 AS percent FROM nation, (VALUES (0), (1)) t(j)),
own AS (SELECT user_id, fingerprint, item, version_id, 'personal' AS origin FROM dev JOIN pref USING (user_id) WHERE mode = 'install' AND version_id IS NOT NULL AND (scope = 'all_devices' OR user_id % 2 = 0)),
byteam AS (SELECT user_id, fingerprint, item, version_id, 'team' AS origin FROM dev JOIN pol USING (team) WHERE {_FNV("seed || ':' || fingerprint")} < percent)"""


def preferences(spark, d) -> tuple[DataFrame, DataFrame]:
    c = F.col("c_custkey")
    p = table(spark, d, "customer").select(c.alias("user_id"), (c % 5).alias("item"), F.when(c % 6 == 0, "exclude").otherwise("install").alias("mode"), F.when(c % 4 == 0, "all_devices").otherwise("selected").alias("scope"), F.when(c % 7 != 0, c % 11).alias("version_id"))
    return p, p.where("user_id % 2 = 0").select("user_id", "item", F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("fingerprint"))


@query("jn19_desired_tools", f"{_WANTED}, b AS (SELECT * FROM own UNION ALL SELECT * FROM byteam ANTI JOIN (SELECT user_id, item FROM own) USING (user_id, item)) SELECT * FROM b ANTI JOIN (SELECT user_id, item FROM pref WHERE mode = 'exclude') USING (user_id, item)")
def _(spark, d):
    prefs, chosen = preferences(spark, d)
    devices = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("fingerprint"), F.col("c_nationkey").alias("team_id"))
    n = F.col("n_nationkey")
    policies = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).select(n.alias("team_id"), ((n + F.col("j")) % 5).cast("long").alias("item"), (F.col("j") + 100).cast("long").alias("version_id"), F.concat(F.lit("s"), n.cast("string")).alias("seed"), (n * 4).alias("percent"))
    return deploy.desired_tools(devices, prefs, chosen, policies)


@query("agg29_preference_devices", "SELECT c_custkey AS user_id, c_custkey % 5 AS item, CASE WHEN c_custkey % 2 = 0 THEN 'd' || c_custkey || ',e' || c_custkey ELSE '' END AS fingerprints FROM customer")
def _(spark, d):
    prefs, chosen = preferences(spark, d)
    more = chosen.unionByName(chosen.withColumn("fingerprint", F.regexp_replace("fingerprint", "^d", "e")))
    return deploy.preference_devices(prefs, more).select("user_id", "item", F.array_join("fingerprints", ",").alias("fingerprints"))


@query("jn14_device_states", """WITH d AS (SELECT o_custkey AS token, 'f' || (o_orderkey % 2) AS fingerprint, max(o_orderdate) AS received_at, arg_max({'h': CASE WHEN o_orderkey % 3 <> 0 THEN 'h' || (o_orderkey % 7) END}, (o_orderdate, o_orderkey)).h AS host FROM orders GROUP BY 1, 2),
c AS (SELECT l_suppkey AS token, 'f' || (l_partkey % 2) AS fingerprint, arg_max({'id': l_orderkey * 10 + l_linenumber, 's': CASE WHEN l_linenumber % 3 = 0 THEN 'done' WHEN l_shipdate <= TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'pending' END}, (l_shipdate, l_orderkey * 10 + l_linenumber)) AS c FROM lineitem GROUP BY 1, 2)
SELECT d.*, CASE WHEN fingerprint = 'f0' THEN c_nationkey END AS generation, CASE WHEN fingerprint = 'f1' AND token % 3 = 0 THEN c_nationkey + 1 END AS applied_generation, c.id AS command_id, c.s AS command_status FROM d LEFT JOIN customer ON c_custkey = token LEFT JOIN c USING (token, fingerprint)""")
def _(spark, d):
    f = lambda c: F.concat(F.lit("f"), (F.col(c) % 2).cast("string")).alias("fingerprint")
    k = F.col("o_orderkey")
    snapshots = table(spark, d, "orders").select(F.col("o_custkey").alias("token"), f("o_orderkey"), F.when(k % 3 != 0, F.concat(F.lit("h"), (k % 7).cast("string"))).otherwise("").alias("host"), F.col("o_orderdate").alias("received_at"), k.alias("snapshot_id"))
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "token")
    policies = c.select("token", F.lit("f0").alias("fingerprint"), F.col("c_nationkey").alias("generation"))
    seen = c.where("token % 3 = 0").select("token", F.lit("f1").alias("fingerprint"), (F.col("c_nationkey") + 1).alias("applied_generation"))
    commands = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("token"), f("l_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("command_id"), F.when(F.col("l_linenumber") % 3 == 0, "done").otherwise("pending").alias("command_status"), F.col("l_shipdate").cast("timestamp").alias("expires_at"), F.col("l_shipdate").alias("created_at"))
    return deploy.device_states(snapshots, policies, seen, commands, "1996-01-01")


_ADDED = lambda a, b: f"list_sort(list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x)))"


@query("alg34_permission_diff", f"""WITH m AS (SELECT p_partkey, ['A' || (p_size % 3), 'B'] AS e0, ['A' || (p_size % 4), 'C' || (p_size % 2), 'C1'] AS e1, [p_brand] AS h0, [p_brand, CASE WHEN p_size % 5 = 0 THEN 'x.org' ELSE p_brand END] AS h1, p_size % 7 = 0 AS s, p_size % 6 = 0 AS c FROM part),
a AS (SELECT *, {_ADDED('e1', 'e0')} AS e, {_ADDED('h1', 'h0')} AS h FROM m) SELECT p_partkey, array_to_string(e, ',') AS added_env, array_to_string(h, ',') AS added_hosts, s AS source_changed, c AS command_changed, len(e) > 0 OR len(h) > 0 OR s OR c AS approval_required FROM a""")
def _(spark, d):
    s = F.col("p_size")
    t = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    b = F.col("p_brand")
    none = F.array().cast("array<string>").alias("components")
    before = F.struct(F.array(t("A", s % 3), F.lit("B")).alias("env"), F.array(b).alias("hosts"), none, F.lit("r").alias("source"), F.lit(None).cast("string").alias("command"))
    after = F.struct(F.array(t("A", s % 4), t("C", s % 2), F.lit("C1")).alias("env"), F.array(b, F.when(s % 5 == 0, "x.org").otherwise(b)).alias("hosts"), none, F.when(s % 7 == 0, "q").otherwise("r").alias("source"), F.when(s % 6 == 0, "run").alias("command"))
    x = table(spark, d, "part").select("p_partkey", before.alias("a"), after.alias("b")).select("p_partkey", *deploy.permission_diff("a", "b"))
    return x.select("p_partkey", F.array_join("added_env", ",").alias("added_env"), F.array_join("added_hosts", ",").alias("added_hosts"), "source_changed", "command_changed", "approval_required")


_VERSIONS = "WITH v AS (SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 17 = 0 THEN 'main' WHEN o_orderkey % 19 = 0 THEN '0.0.0' ELSE (o_orderkey % 3) || '.' || (o_custkey % 12 + o_orderkey % 4) || '.' || (o_orderkey % 5) END AS version FROM orders), n AS (SELECT *, CASE WHEN version <> 'main' THEN list_transform(string_split(version, '.'), lambda x: x::INT) END AS k FROM v)"


def versions(spark, d) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(c.alias("user_id"), F.when(o % 17 == 0, "main").when(o % 19 == 0, "0.0.0").otherwise(F.concat_ws(".", (o % 3).cast("string"), (c % 12 + o % 4).cast("string"), (o % 5).cast("string"))).alias("version"))


@query("agg32_worst_version", f"{_VERSIONS} SELECT user_id, arg_min(version, k) AS version FROM n WHERE k IS NOT NULL GROUP BY 1")
def _(spark, d):
    return deploy.worst_versions(versions(spark, d))


@query("alg35_outdated", f"{_VERSIONS} SELECT version, coalesce(version <> '0.0.0' AND k < [1, 10, 2], false) AS outdated FROM n GROUP BY version, k")
def _(spark, d):
    return versions(spark, d).select("version").distinct().withColumn("outdated", deploy.outdated(F.col("version"), F.lit("v1.10.2")))


@query("agg31_team_counts", f"WITH {T.EV}, t AS (SELECT {T.TEAM} AS team_id FROM ev) SELECT n_nationkey::BIGINT AS team_id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members, EXISTS (SELECT 1 FROM t WHERE team_id = n_nationkey) AS has_events FROM nation")
def _(spark, d):
    members = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("team_id")).agg(F.count(F.lit(1)).alias("members"))
    active = teamed(spark, d).where("team_id IS NOT NULL").select("team_id").distinct().withColumn("has_events", F.lit(True))
    return T.teams(spark, d).join(members, "team_id", "left").join(active, "team_id", "left").select("team_id", F.col("label").alias("name"), F.coalesce("members", F.lit(0)).cast("long").alias("members"), F.coalesce("has_events", F.lit(False)).alias("has_events"))


# Repair

_REPAIR = f"""{_ASOF}, q AS (SELECT *, coalesce({_RATE('input_tokens', 'input', 'input_above')} + {_RATE('output_tokens', 'output', 'output_above')} + cache_read_tokens * coalesce(cache_read, input * 0.1) / 1e6 + cache_creation_tokens * coalesce(cache_creation, input * 1.25) / 1e6, 0) AS price FROM j WHERE n = 1 AND cost_status <> 'priced')"""


@query("alg21_price_repair", f"{_REPAIR} SELECT event_id, CASE WHEN id IS NULL THEN 'unpriced' WHEN cost_status = 'unpriced' THEN 'recovered' ELSE 'repriced' END AS outcome, round(price, 9) AS price FROM q")
def _(spark, d):
    return repair.price_repair(large(spark, d), T.revisions(spark)).select("event_id", "outcome", "price")


@query("agg24_repair_days", f"{_REPAIR} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE id IS NOT NULL AND cost_status = 'unpriced') AS recovered, count(*) FILTER (WHERE id IS NOT NULL AND cost_status <> 'unpriced') AS repriced FROM q GROUP BY 1")
def _(spark, d):
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return repair.price_repair(large(spark, d), T.revisions(spark)).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n("recovered"), n("repriced"))


@query("alg22_stale_buckets", "WITH x AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket FROM events WHERE event_id % 10 = 0 AND user_id % 3 = 0), y AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket FROM events WHERE user_id = 6) SELECT bucket FROM x ANTI JOIN y USING (bucket)")
def _(spark, d):
    """The rollup was made when every third user's unpriced events were still priced."""
    e = T.usage_events(spark, d)
    old = e.withColumn("cost_status", F.when((F.col("cost_status") == "unpriced") & (F.col("user_id") % 3 == 0), "priced").otherwise(F.col("cost_status")))
    return repair.stale_buckets(e, rollup.compact(old), ingest.dirty_buckets(e.where("user_id = 6"))).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"))


@query("alg23_team_backfill", f"{TEAMED} SELECT event_id, CASE WHEN user_id = 9 AND team_id IS NULL AND {PERIOD} THEN 77 ELSE team_id END AS team_id, coalesce(user_id = 9 AND team_id IS NULL AND {PERIOD}, false) AS filled FROM t")
def _(spark, d):
    return repair.team_backfill(teamed(spark, d), 9, 77, SCOPE.start, SCOPE.end).select("event_id", "team_id", "filled")


@query("alg24_membership_change", """WITH u AS (SELECT DISTINCT user_id FROM events), m AS (SELECT user_id, (user_id + 3) % 25 AS team_id, TIMESTAMP '2024-01-22' AS moved FROM u WHERE user_id % 4 = 1),
a AS (SELECT user_id, user_id % 25 AS team_id, NULL::TIMESTAMP AS effective_from, TIMESTAMP '2024-01-15' AS effective_to FROM u WHERE user_id % 10 <> 9 UNION ALL SELECT user_id, (user_id + 7) % 25, TIMESTAMP '2024-01-18', CASE WHEN user_id % 4 = 1 THEN TIMESTAMP '2024-01-22' END FROM u WHERE user_id % 10 <> 9)
SELECT * FROM a UNION ALL SELECT user_id, team_id, CASE WHEN user_id % 10 <> 9 THEN moved END, NULL FROM m""")
def _(spark, d):
    a = T.assignments(spark, d)
    moves = table(spark, d, "events").where("user_id % 4 = 1").select("user_id").distinct().select("user_id", ((F.col("user_id") + 3) % 25).alias("team_id"), F.lit("2024-01-22").cast("timestamp").alias("at"))
    return repair.moved_members(a, moves).select("user_id", "team_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("effective_from", "effective_to")])


@query("alg25_price_sync", f"WITH r AS ({T.revisions_sql()}), l AS (SELECT model_id, arg_max({{'i': input, 'o': output}}, (effective_at, id)) AS l FROM r GROUP BY 1), p AS (SELECT 'm' || i AS model_id, 1.0::DOUBLE + i AS input, CASE WHEN i = 4 THEN 1.25 ELSE 5 * (i::DOUBLE) END AS output FROM range(9) t(i)) SELECT p.* FROM p LEFT JOIN l USING (model_id) WHERE l IS NULL OR l.i <> input OR l.o <> output")
def _(spark, d):
    i = F.col("id")
    prices = spark.range(9).select(F.concat(F.lit("m"), i.cast("string")).alias("model_id"), (i + 1.0).alias("input"), F.when(i == 4, 1.25).otherwise(i * 5.0).alias("output"))
    return repair.changed_prices(prices, T.revisions(spark), ["input", "output"])


@query("agg37_counters", "SELECT l_returnflag AS state, sum(CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE 1 END)::BIGINT AS n, true AS sound FROM lineitem GROUP BY 1 UNION ALL SELECT 'moved', count(*), true FROM lineitem WHERE l_orderkey % 4 = 0")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("state"), "l_orderkey")
    seed = li.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    gone = li.where("l_orderkey % 4 = 0")
    return repair.counters(seed, gone, gone.withColumn("state", F.lit("moved")), ["state"])


# Jobs

_JOBS = f"""WITH b AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS ts FROM events WHERE user_id < 5),
f AS (SELECT DISTINCT zone, unit, label FROM (SELECT '{SEOUL}' AS zone, 'day' AS unit, {label(SEOUL)} AS label FROM b UNION ALL SELECT '{SEOUL}', 'hour', {label(SEOUL, '%Y-%m-%d %H:00')} FROM b UNION ALL SELECT '{YORK}', 'day', {label(YORK)} FROM b UNION ALL SELECT '{YORK}', 'hour', {label(YORK, '%Y-%m-%d %H:00')} FROM b)),
k AS (SELECT DISTINCT '{SEOUL}' AS zone, 'day' AS unit, {label(SEOUL)} AS label FROM events WHERE user_id % 2 = 1),
i AS (SELECT zone, unit, label, CASE WHEN f.label IS NULL THEN 'done' ELSE 'pending' END AS state, (CASE WHEN k.label IS NULL THEN 0 ELSE 3 END + CASE WHEN f.label IS NULL THEN 0 ELSE 1 END)::BIGINT AS generation FROM k FULL JOIN f USING (zone, unit, label))"""


def job_table(spark, d) -> DataFrame:
    e = T.usage_events(spark, d)
    known = e.where("user_id % 2 = 1").select(F.lit(SEOUL).alias("zone"), F.lit("day").alias("unit"), X.bucket_label("ts", SEOUL).alias("label")).distinct().select("*", F.lit("done").alias("state"), F.lit(3).cast("long").alias("generation"))
    return jobs.invalidated(known, jobs.affected_jobs(ingest.dirty_buckets(e.where("user_id < 5")), [SEOUL, YORK]))


@query("str6_job_invalidation", f"{_JOBS} SELECT * FROM i")
def _(spark, d):
    return job_table(spark, d)


@query("agg35_job_backlog", f"{_JOBS} SELECT zone, count(*) FILTER (WHERE state = 'pending' AND unit = 'hour') AS pending_hours, count(*) FILTER (WHERE state = 'pending' AND unit = 'day') AS pending_days, 0::BIGINT AS running_hours, 0::BIGINT AS running_days, min(label) FILTER (WHERE state = 'pending') AS oldest FROM i GROUP BY 1")
def _(spark, d):
    return jobs.backlog(job_table(spark, d))


# Sources, sinks and sets over events


@query("src4_local_days", f"WITH {T.EV} SELECT {label(YORK)} AS bucket, count(*)::BIGINT AS events, sum(input_tokens)::BIGINT AS input_tokens, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1")
def _(spark, d):
    days = rollup.local_rollup(rollup.compact(T.usage_events(spark, d)), YORK)
    return days.groupBy("bucket").agg(F.sum("event_count").cast("long").alias("events"), F.sum("input_tokens").cast("long").alias("input_tokens"), F.countDistinct("session_id").alias("sessions"))


@query("snk4_mart_rebuild", f"WITH {T.EV} SELECT {label(SEOUL)} AS day, user_id, provider_key, count(DISTINCT session_id) AS sessions, {COST}, {TOKENS}, count(*) AS events FROM ev WHERE {label(SEOUL)} IN ('2024-01-16', '2024-01-17') GROUP BY 1, 2, 3")
def _(spark, d):
    days = X.bucket_label("ts", SEOUL).isin("2024-01-16", "2024-01-17")
    near = (F.col("ts") >= F.lit("2024-01-15").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-18").cast("timestamp"))
    return ingest.daily_mart(T.usage_events(spark, d).where(near & days), SEOUL, "user_id")


@query("snk8_versioned_replacement", f"WITH {T.EV} SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'priced' ELSE cost_status END AS cost_status FROM ev")
def _(spark, d):
    e = T.usage_events(spark, d).withColumn("version", F.lit(1))
    again = e.where("event_id % 6 = 0").withColumn("cost_status", F.lit("priced")).withColumn("version", F.lit(2))
    return ingest.latest(e.unionByName(again)).select("event_id", "cost_status")


@query("snk13_retention", "SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1")
def _(spark, d):
    return T.table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-31' - interval 7 days").groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("snk15_operation_counters", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS operation, CASE WHEN event_id % 9 = 0 THEN 'failure' ELSE 'success' END AS outcome, count(*) AS operations, sum(event_id % 100)::BIGINT AS latency_ms FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    i = F.col("event_id")
    one = T.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("operation"), F.when(i % 9 == 0, "failure").otherwise("success").alias("outcome"), F.lit(1).cast("long").alias("operations"), (i % 100).alias("latency_ms"), i)
    keys, sums = ["day", "operation", "outcome"], ["operations", "latency_ms"]
    part = lambda p: one.where(p).groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums])
    return ingest.added(part("event_id % 2 = 0"), part("event_id % 2 = 1"), keys, sums)


@query("snk16_newest_device", "SELECT token, host, o_orderkey FROM (SELECT o_custkey AS token, 'h' || (o_orderkey % 3) AS host, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def _(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_custkey").alias("token"), F.concat(F.lit("h"), (F.col("o_orderkey") % 3).cast("string")).alias("host"), "o_orderkey", "o_orderdate")
    return o.groupBy("token", "host").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("snk7_bucket_replacement", f"WITH {T.EV} SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, sum(CASE WHEN user_id < 8 THEN 2 * input_tokens ELSE input_tokens END)::BIGINT AS input_tokens FROM ev GROUP BY 1")
def _(spark, d):
    """Buckets of changed users are compacted again under a higher version and replace the old rows whole."""
    e = T.usage_events(spark, d)
    changed = e.withColumn("input_tokens", F.when(F.col("user_id") < 8, F.col("input_tokens") * 2).otherwise(F.col("input_tokens")))
    again = changed.withColumn("bucket", X.bucket_start("ts")).join(ingest.dirty_buckets(e.where("user_id < 8")), "bucket", "left_semi")
    rows = rollup.collapse(rollup.compact(e).unionByName(rollup.compact(again, 2)))
    return rows.groupBy(F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.sum("input_tokens").cast("long").alias("input_tokens"))


@query("flt11_null_safe", f"WITH {T.EV} SELECT a.event_id FROM ev a WHERE EXISTS (SELECT 1 FROM ev b WHERE b.event_id % 50 = 0 AND a.host IS NOT DISTINCT FROM b.host AND a.model IS NOT DISTINCT FROM b.model AND a.user_id = b.user_id)")
def _(spark, d):
    e = T.usage_events(spark, d)
    b = e.where("event_id % 50 = 0").select(F.col("host").alias("bh"), F.col("model").alias("bm"), F.col("user_id").alias("bu"))
    return e.join(b, F.col("host").eqNullSafe(F.col("bh")) & F.col("model").eqNullSafe(F.col("bm")) & (F.col("user_id") == F.col("bu")), "left_semi").select("event_id")


@query("jn17_usage_and_tool_days", f"WITH {T.TOOLS}, u AS (SELECT user_id, {label(SEOUL)} AS day, count(*) AS events FROM ev WHERE provider_key = 'view' GROUP BY 1, 2), t AS (SELECT user_id, {label(SEOUL)} AS day, count(*) AS calls FROM tl WHERE activity_kind = 'skill' GROUP BY 1, 2) SELECT user_id, day, coalesce(events, 0) AS events, coalesce(calls, 0) AS calls FROM u FULL JOIN t USING (user_id, day)")
def _(spark, d):
    n = lambda df, name: df.groupBy("user_id", X.bucket_label("ts", SEOUL).alias("day")).agg(F.count(F.lit(1)).alias(name))
    u = n(T.usage_events(spark, d).where("provider_key = 'view'"), "events")
    t = n(T.tool_events(spark, d).where("activity_kind = 'skill'"), "calls")
    return u.join(t, ["user_id", "day"], "full").na.fill(0, ["events", "calls"])


@query("win2_group_total", f"{_TURNS}, g AS ({_GROUPS}) SELECT session, turns, count(*) OVER () AS groups FROM g ORDER BY turns DESC, session LIMIT 20")
def _(spark, d):
    """The total comes from an aggregate of its own: a window over everything would be one task."""
    g = history.groups(turns(spark, d)).select("session", "turns")
    return g.orderBy(F.desc("turns"), "session").limit(20).crossJoin(g.agg(F.count(F.lit(1)).alias("groups")))


@query("top2_offset_page", f"{_TURNS}, g AS ({_GROUPS}) SELECT session, turns FROM g ORDER BY turns DESC, session LIMIT 20 OFFSET 40")
def _(spark, d):
    return history.groups(turns(spark, d)).select("session", "turns").orderBy(F.desc("turns"), "session").offset(40).limit(20)


@query("win6_changed_totals", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders) WHERE was IS DISTINCT FROM o_orderstatus")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return T.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.lag("o_orderstatus").over(w).alias("was")).where(~F.col("was").eqNullSafe(F.col("o_orderstatus"))).select("o_custkey", "o_orderkey")


@query("top4_oldest_batch", f"WITH {T.EV} SELECT dedup_key, ts FROM ev WHERE cost_status = 'unpriced' ORDER BY ts, dedup_key LIMIT 100")
def _(spark, d):
    return T.usage_events(spark, d).where("cost_status = 'unpriced'").select("dedup_key", "ts").orderBy("ts", "dedup_key").limit(100).select("dedup_key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("tim1_hourly_buckets", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type AS provider_key, count(*) AS events FROM events GROUP BY 1, 2")
def _(spark, d):
    return T.usage_events(spark, d).groupBy(X.bucket_start("ts", 60).cast("timestamp_ntz").alias("bucket"), "provider_key").agg(F.count(F.lit(1)).alias("events"))


@query("tim8_day_offset", f"{BASE} SELECT date_diff('day', DATE '{START}', timezone('{SEOUL}', timezone('UTC', ts))::DATE)::INT AS day, {COST}, count(*) AS events FROM p GROUP BY 1")
def _(spark, d):
    return ev(spark, d).groupBy(F.date_diff(X.local("ts", SEOUL).cast("date"), F.lit(START).cast("date")).alias("day")).agg(X.priced_cost().alias("cost"), F.count(F.lit(1)).alias("events"))


@query("agg38_leader_shares", f"{BASE}, l AS (SELECT user_id, sum(tokens) AS t FROM p GROUP BY 1 ORDER BY t DESC, user_id LIMIT 10) SELECT sum(t)::BIGINT AS tokens, floor(100 * sum(t) FILTER (WHERE n <= 3) / sum(t) + 0.5)::BIGINT AS top_three_share FROM (SELECT t, row_number() OVER (ORDER BY t DESC, user_id) AS n FROM l)")
def _(spark, d):
    sums = ev(spark, d).groupBy("user_id").agg(F.sum(X.total_tokens()).cast("long").alias("t"))
    best = sums.orderBy(F.desc("t"), "user_id").limit(10).agg(F.array_sort(F.collect_list("t")).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return best.select(total(F.col("v")).alias("tokens"), X.js_round(100 * total(F.slice("v", -3, 3)) / total(F.col("v"))).cast("long").alias("top_three_share"))


@query("jn1_user_labels", f"{BASE} SELECT user_id, c_name AS label, {COVER} FROM p JOIN customer ON c_custkey = user_id GROUP BY 1, 2")
def _(spark, d):
    return ev(spark, d).groupBy("user_id").agg(*X.coverage()).join(T.users(spark, d), "user_id")


@query("flt5_zero_usage", f"WITH {T.EV} SELECT provider_key, count(*) AS events FROM ev WHERE tokens > 0 GROUP BY 1")
def _(spark, d):
    return T.usage_events(spark, d).where(X.total_tokens() > 0).groupBy("provider_key").agg(F.count(F.lit(1)).alias("events"))


@query("agg30_operations_report", "WITH b AS (SELECT event_type AS operation, CASE WHEN event_id % 9 = 0 THEN 'failure' ELSE 'success' END AS outcome, user_id % 3 AS provider, event_id % 100 AS ms FROM events WHERE ts >= TIMESTAMP '2024-01-02'), g AS (SELECT operation, outcome, count(*) AS operations, sum(ms)::BIGINT AS latency_ms FROM b GROUP BY 1, 2), a AS (SELECT count(*) FILTER (WHERE provider = 1) AS active_operations FROM b) SELECT * FROM a LEFT JOIN g ON true")
def _(spark, d):
    """One row at least: the active provider's total stands also where there is nothing to group."""
    i = F.col("event_id")
    b = table(spark, d, "events").where("ts >= timestamp_ntz'2024-01-02'").select(F.col("event_type").alias("operation"), F.when(i % 9 == 0, "failure").otherwise("success").alias("outcome"), (F.col("user_id") % 3).alias("provider"), (i % 100).alias("ms"))
    active = b.agg(F.count_if(F.col("provider") == 1).alias("active_operations"))
    return active.join(b.groupBy("operation", "outcome").agg(F.count(F.lit(1)).alias("operations"), F.sum("ms").cast("long").alias("latency_ms")), F.lit(True), "left")


@query("flt10_agent_scope", f"{_TURNS} SELECT session, count(*) FILTER (WHERE role <> 'assistant') AS main_turns, count(*) FILTER (WHERE role = 'assistant') AS agent_turns FROM t GROUP BY 1")
def _(spark, d):
    t = turns(spark, d).withColumn("agent_id", F.when(F.col("role") == "assistant", F.concat(F.lit("a"), (F.col("turn") % 2).cast("string"))))
    return t.groupBy("session").agg(F.count_if(F.col("agent_id").isNull()).alias("main_turns"), F.count_if(F.col("agent_id").isNotNull()).alias("agent_turns"))


@query("flt15_tuple_membership", f"WITH {T.EV} SELECT event_id FROM ev WHERE (user_id, provider_key, host) IN (SELECT user_id, provider_key, host FROM ev WHERE event_id % 100 = 0 AND host IS NOT NULL)")
def _(spark, d):
    e = T.usage_events(spark, d)
    return e.join(e.where("event_id % 100 = 0").select("user_id", "provider_key", "host"), ["user_id", "provider_key", "host"], "left_semi").select("event_id")


@query("win9_leaderboard_rank", f"{BASE}, s AS (SELECT user_id, sum(tokens)::BIGINT AS tokens FROM p GROUP BY 1) SELECT user_id, tokens, row_number() OVER (ORDER BY tokens DESC, user_id) AS rank FROM s ORDER BY rank LIMIT 5")
def _(spark, d):
    """Only the five rows shown are numbered."""
    best = ev(spark, d).groupBy("user_id").agg(F.sum(X.total_tokens()).cast("long").alias("tokens")).orderBy(F.desc("tokens"), "user_id").limit(5)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tokens"), "user_id")).cast("long"))


@query("top9_nulls_last", f"{BASE}, s AS (SELECT model, max(ts) FILTER (WHERE host IS NOT NULL AND model <> 'm3') AS last_seen FROM p GROUP BY 1) SELECT model, last_seen FROM s ORDER BY last_seen DESC NULLS LAST, model NULLS LAST LIMIT 7")
def _(spark, d):
    s = ev(spark, d).groupBy("model").agg(F.max(F.when(F.col("host").isNotNull() & (F.col("model") != "m3"), F.col("ts"))).cast("timestamp_ntz").alias("last_seen"))
    return s.orderBy(F.desc_nulls_last("last_seen"), F.asc_nulls_last("model")).limit(7)
