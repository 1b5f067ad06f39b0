"""The engine's tables over the driver's parquet files, and the same relations as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Price revisions of the examples: id, model, effective, valid until, prices per million tokens.
REVISIONS = [
    (1, "m0", "2024-01-01", None, 3.0, 15.0, 0.3, 3.75, 6.0, 22.5, 2.0),
    (2, "m0", "2024-01-10", "2024-01-12", 4.0, 20.0, None, None, None, None, None),
    (3, "m1", "2024-01-08", None, 1.0, 5.0, None, None, None, None, None),
    (4, "m2", "2023-12-01", None, 2.0, 8.0, 0.5, None, 4.0, 12.0, None),
    (5, "m2", "2024-01-15", None, 2.5, 10.0, 0.5, 2.5, 5.0, 15.0, 1.5),
    (6, "m3", "2024-01-01", "2024-01-20", 10.0, 30.0, 1.0, 12.5, None, None, None),
    (7, "m4", "2024-01-01", None, 0.25, 1.25, 0.03, 0.3, None, None, None),
]
_NAMES = "id model_id effective_at valid_until input output cache_read cache_creation input_above output_above fast".split()


def _sql(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def revisions_sql(spark_types: bool = False) -> str:
    rows = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in REVISIONS)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(_NAMES, ["INT", "STRING" if spark_types else "VARCHAR", "TIMESTAMP", "TIMESTAMP", *["DOUBLE"] * 7]))
    return f"SELECT {casts} FROM (VALUES {rows}) AS v({', '.join(_NAMES)})"


def revisions(spark: SparkSession) -> DataFrame:
    return spark.sql(revisions_sql(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as usage events; event_id stays for tie-breaks."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        i,
        F.sha2(i.cast("string"), 256).alias("dedup_key"),
        F.col("event_type").alias("provider_key"),
        "user_id",
        F.when(i % 17 != 0, F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))).alias("session_id"),
        F.when(i % 11 != 0, F.concat(F.lit("m"), (i % 7).cast("string"))).alias("model"),
        F.when(i % 13 != 0, F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string"))).alias("host"),
        F.col("ts").cast("timestamp").alias("ts"),
        (k * 10).alias("input_tokens"),
        (k * 3).alias("output_tokens"),
        (k * 5).alias("cache_read_tokens"),
        k.alias("cache_creation_tokens"),
        F.col("value").cast("decimal(18,8)").alias("cost_usd"),
        F.when(i % 10 == 0, "unpriced").when(i % 10 == 1, "legacy").otherwise("priced").alias("cost_status"),
        F.lit(1).cast("long").alias("event_count"),
    )


EV = """ev AS (SELECT event_id, sha256(event_id::VARCHAR) AS dedup_key, event_type AS provider_key, user_id,
  CASE WHEN event_id % 17 <> 0 THEN user_id || '-' || strftime(ts, '%Y%m%d') END AS session_id,
  CASE WHEN event_id % 11 <> 0 THEN 'm' || (event_id % 7) END AS model,
  CASE WHEN event_id % 13 <> 0 THEN 'h' || (user_id % 4) END AS host, ts,
  k * 10 AS input_tokens, k * 3 AS output_tokens, k * 5 AS cache_read_tokens, k AS cache_creation_tokens, k * 19 AS tokens,
  value::DECIMAL(18,8) AS cost_usd,
  CASE event_id % 10 WHEN 0 THEN 'unpriced' WHEN 1 THEN 'legacy' ELSE 'priced' END AS cost_status
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams of users over time: two intervals with a gap between them; every tenth user has none."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 10 <> 9")
    first = users.select("user_id", (F.col("user_id") % 25).alias("team_id"), F.lit(None).cast("timestamp").alias("effective_from"), F.lit("2024-01-15").cast("timestamp").alias("effective_to"))
    second = users.select("user_id", ((F.col("user_id") + 7) % 25).alias("team_id"), F.lit("2024-01-18").cast("timestamp").alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"))
    return first.unionByName(second)


TEAM = "CASE WHEN user_id % 10 = 9 THEN NULL WHEN ts < TIMESTAMP '2024-01-15' THEN user_id % 25 WHEN ts >= TIMESTAMP '2024-01-18' THEN (user_id + 7) % 25 END"


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = usage_events(spark, sf_dir)
    k = F.col("cache_creation_tokens")
    return e.select(
        "event_id", "user_id", "session_id", "host", "ts",
        F.when(F.col("provider_key").isin("click", "view"), "mcp").otherwise("skill").alias("activity_kind"),
        F.col("provider_key").alias("item_key"),
        F.when((F.col("provider_key") == "error") | (k % 5 == 0), "failure").when(k % 7 == 0, "unknown").otherwise("success").alias("outcome"),
    )


TOOLS = EV + """, tl AS (SELECT event_id, user_id, session_id, host, ts,
  CASE WHEN provider_key IN ('click', 'view') THEN 'mcp' ELSE 'skill' END AS activity_kind, provider_key AS item_key,
  CASE WHEN provider_key = 'error' OR cache_creation_tokens % 5 = 0 THEN 'failure' WHEN cache_creation_tokens % 7 = 0 THEN 'unknown' ELSE 'success' END AS outcome FROM ev)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("label"))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("label"))
