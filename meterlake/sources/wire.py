"""Bodies of the collection API, a body a row: tool activity, tool inventory, prompts.  Every item comes out, with an error if it isn't sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the wire: the keys of each object, and how many items a body may have.
ACTIVITY = "dedupKey providerKey sessionId host ts activityKind itemKey displayName pluginKey outcome detection".split()
ITEM = "kind itemKey displayName sourceProvider pluginKey version enabled".split()
INVENTORY = "host fingerprint observedAt items".split()
MOST_ACTIVITY, MOST_ITEMS, MOST_BYTES, MOST_DEPTH = 500, 2000, 1_048_576, 32
SHA256 = "^[a-f0-9]{64}$"


def field(item: Column, name: str) -> Column:
    return F.get_json_object(item, f"$.{name}")


def moment(item: Column, name: str) -> Column:
    return F.try_to_timestamp(field(item, name))


def _length(item: Column, name: str, most: int, needed: bool = True) -> Column:
    n = F.length(field(item, name))
    return F.coalesce((n == 0) | (n > most), F.lit(needed))


def _unknown(item: Column, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.json_object_keys(item), F.array(*map(F.lit, keys)))) > 0, F.lit(True))


def _other(item: Column, name: str, *allowed: str) -> Column:
    return ~F.coalesce(field(item, name).isin(*allowed), F.lit(False))


def _not_hash(item: Column, name: str) -> Column:
    return ~F.coalesce(F.rlike(field(item, name), F.lit(SHA256)), F.lit(False))


def _first(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that is true, null if none is."""
    return F.coalesce(*[F.when(bad, name) for name, bad in checks])


def items(bodies: DataFrame, column: str = "value", path: str = "$") -> DataFrame:
    """The items of bodies with their position; of a body that has no array, one row without an item."""
    listed = F.from_json(F.get_json_object(column, path), "array<string>")
    whole = bodies.withColumn("n_items", F.coalesce(F.size(listed), F.lit(-1)))
    return whole.select("*", F.posexplode_outer(listed).alias("position", "item")).where("n_items <> 0")


def activity(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Tool activity with `error` (null if sound); columns of the body's row stay."""
    i = F.col("item")
    error = _first([
        ("body", F.col("n_items") < 0), ("length", F.col("n_items") > MOST_ACTIVITY), ("unknown", _unknown(i, ACTIVITY)),
        ("dedupKey", _not_hash(i, "dedupKey")), ("providerKey", _length(i, "providerKey", 100)), ("sessionId", _length(i, "sessionId", 500, False)),
        ("host", _length(i, "host", 255, False)), ("ts", moment(i, "ts").isNull()), ("activityKind", _other(i, "activityKind", "mcp", "skill")),
        ("itemKey", _length(i, "itemKey", 200)), ("displayName", _length(i, "displayName", 200)), ("pluginKey", _length(i, "pluginKey", 200, False)),
        ("outcome", _other(i, "outcome", "success", "failure", "unknown")), ("detection", _other(i, "detection", "explicit", "derived_load")),
    ])
    plain = {"dedup_key": "dedupKey", "provider_key": "providerKey", "session_id": "sessionId", "host": "host", "activity_kind": "activityKind", "item_key": "itemKey", "display_name": "displayName", "plugin_key": "pluginKey", "outcome": "outcome", "detection": "detection"}
    return items(bodies, column).select(*bodies.columns, "position", *[field(i, b).alias(a) for a, b in plain.items()], moment(i, "ts").alias("ts"), error.alias("error"))


def inventory(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Items of inventories with `error` (null if sound, else of the snapshot or of the item)."""
    b, i = F.col(column), F.col("item")
    whole = _first([("unknown", _unknown(b, INVENTORY)), ("fingerprint", _not_hash(b, "fingerprint")), ("observedAt", moment(b, "observedAt").isNull()), ("host", _length(b, "host", 255, False)), ("items", F.col("n_items") < 0), ("length", F.col("n_items") > MOST_ITEMS)])
    one = _first([
        ("item.unknown", _unknown(i, ITEM)), ("item.enabled", field(i, "enabled").try_cast("boolean").isNull()), ("item.kind", _other(i, "kind", "mcp", "skill", "plugin")),
        ("item.itemKey", _length(i, "itemKey", 200)), ("item.displayName", _length(i, "displayName", 200)), ("item.sourceProvider", _length(i, "sourceProvider", 100)),
        ("item.pluginKey", _length(i, "pluginKey", 200, False)), ("item.version", _length(i, "version", 100, False)),
    ])
    x = items(bodies, column, "$.items")
    return x.select(*bodies.columns, field(b, "fingerprint").alias("fingerprint"), field(b, "host").alias("host"), moment(b, "observedAt").alias("observed_at"), "position", field(i, "kind").alias("kind"), field(i, "itemKey").alias("item_key"), field(i, "sourceProvider").alias("source_provider"), field(i, "version").alias("version"), field(i, "enabled").try_cast("boolean").alias("enabled"), F.coalesce(whole, one).alias("error"))


def prompts(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Prompt records with their agent and `error` (null if sound)."""
    i = F.col("item")
    agent = field(i, "agent").isNotNull()
    depth = field(i, "agent.depth")
    n = depth.try_cast("int")
    error = _first([
        ("body", F.col("n_items") < 0), ("dedupKey", _length(i, "dedupKey", 1 << 30)), ("providerKey", _length(i, "providerKey", 1 << 30)), ("sessionId", _length(i, "sessionId", 255, False)),
        ("turnRole", _other(i, "turnRole", "user", "assistant")), ("ts", moment(i, "ts").isNull()), ("text", F.coalesce((F.octet_length(field(i, "text")) == 0) | (F.octet_length(field(i, "text")) > MOST_BYTES), F.lit(True))),
        ("agent.id", agent & _length(i, "agent.id", 255)), ("agent.parentId", agent & _length(i, "agent.parentId", 255, False)), ("agent.name", agent & _length(i, "agent.name", 100, False)), ("agent.role", agent & _length(i, "agent.role", 100, False)),
        ("agent.depth", agent & depth.isNotNull() & (n.isNull() | (n < 1) | (n > MOST_DEPTH))),
    ])
    plain = {"dedup_key": "dedupKey", "provider_key": "providerKey", "session_id": "sessionId", "turn_role": "turnRole", "text": "text", "agent_id": "agent.id", "agent_parent_id": "agent.parentId", "agent_name": "agent.name", "agent_role": "agent.role"}
    return items(bodies, column).select(*bodies.columns, "position", *[field(i, b).alias(a) for a, b in plain.items()], n.alias("agent_depth"), moment(i, "ts").alias("ts"), error.alias("error"))
