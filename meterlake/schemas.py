"""Declared schemas; nothing is inferred."""

from __future__ import annotations

USAGE_EVENT = """dedup_key string, provider_key string, user_id bigint, session_id string, model string, host string,
ts timestamp, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint,
cost_usd decimal(18,8), cost_status string, log_adapter string, event_count bigint"""

USAGE_WIRE = """dedupKey string, providerKey string, userId string, sessionId string, model string, host string, ts string,
inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, cacheCreationTokens bigint, cacheCreation1hTokens bigint,
costUsd double, logAdapter string"""

ATTRIBUTE = "struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>"
OTLP_LOGS = f"""struct<resourceLogs:array<struct<resource:struct<attributes:array<{ATTRIBUTE}>>,
scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,
eventName:string,attributes:array<{ATTRIBUTE}>>>>>>>>"""

PRICE_REVISION = """id int, model_id string, effective_at timestamp, valid_until timestamp, input double, output double,
cache_read double, cache_creation double, input_above double, output_above double, fast double"""
