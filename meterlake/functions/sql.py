"""The shared expressions as temporary functions of SQL, with the same results as their DataFrame forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = {
    "usage_day(at TIMESTAMP, zone STRING) RETURNS STRING": "date_format(from_utc_timestamp(to_utc_timestamp(at, current_timezone()), zone), 'yyyy-MM-dd')",
    "usage_bucket(at TIMESTAMP) RETURNS TIMESTAMP": "timestamp_micros(unix_micros(at) - pmod(unix_micros(at), 900000000))",
    "usage_tokens(input BIGINT, output BIGINT, cache_read BIGINT, cache_creation BIGINT) RETURNS BIGINT": "input + output + cache_read + cache_creation",
    "usage_coverage(priced BIGINT, unpriced BIGINT, legacy BIGINT) RETURNS STRING": "CASE WHEN unpriced > 0 AND priced + legacy > 0 THEN 'partial' WHEN unpriced > 0 THEN 'unpriced' WHEN legacy > 0 THEN 'legacy' ELSE 'complete' END",
    "usage_is_meta(text STRING) RETURNS BOOLEAN": None,
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session; registering them again does no harm."""
    from .exprs import META_TAGS

    for head, body in FUNCTIONS.items():
        body = body or "coalesce(rlike(text, r'^\\s*<(?:" + "|".join(META_TAGS) + ")[\\s>]'), false)"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


_COLUMNS = "sessions BIGINT, active_users BIGINT, cost DOUBLE, input_tokens BIGINT, output_tokens BIGINT, cache_read_tokens BIGINT, cache_creation_tokens BIGINT"
_SUMS = ", ".join(f"CAST(coalesce(sum({x}_tokens), 0) AS BIGINT)" for x in ("input", "output", "cache_read", "cache_creation"))
_COVER = ", ".join(f"CAST(coalesce(sum(CASE WHEN cost_status = '{s}' THEN event_count END), 0) AS BIGINT)" for s in ("priced", "unpriced", "legacy"))
_MEASURES = f"count(DISTINCT nullif(session_id, '')), count(DISTINCT user_id), round(coalesce(CAST(sum(CASE WHEN cost_status <> 'unpriced' THEN cost_usd END) AS DOUBLE), 0), 4), {_SUMS}"


def register_tables(spark: SparkSession, events: DataFrame, zone: str = "UTC", view: str = "usage_rows") -> None:
    """Makes table functions over events known to a session; SQL may also join them laterally to a table of scopes:

    usage_overview(since, until): one row of measures and cost coverage, also of nothing; usage_series(since, until): a row
    a local day of the zone.  Periods are half-open.  events may be what a store's questions read.  Scopes that are joined
    are few: each event meets those that hold its time, and all scopes go to every task.
    """
    events.createOrReplaceTempView(view)
    register(spark)
    within = f"FROM {view} AS e WHERE e.ts >= usage_{{0}}.since AND e.ts < usage_{{0}}.until"
    made = {
        f"usage_overview(since TIMESTAMP, until TIMESTAMP) RETURNS TABLE ({_COLUMNS}, priced_events BIGINT, unpriced_events BIGINT, legacy_events BIGINT)": f"SELECT {_MEASURES}, {_COVER} {within.format('overview')}",
        f"usage_series(since TIMESTAMP, until TIMESTAMP) RETURNS TABLE (bucket STRING, {_COLUMNS})": f"SELECT date_format(from_utc_timestamp(to_utc_timestamp(e.ts, current_timezone()), '{zone}'), 'yyyy-MM-dd'), {_MEASURES} {within.format('series')} GROUP BY 1",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
