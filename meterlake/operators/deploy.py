"""Tool catalogue, device state, staged rollouts and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

#: A rollout is rolled back from 2 failures or a share of 0.2 on; a phase needs this many minutes and this
#: share of the eligible devices attempted before the next phase, which reaches the given percentage.
MOST_FAILURES, MOST_FAILED_SHARE = 2, 0.2
PHASES = {"canary": (30, 0.1, "expand", 50), "expand": (60, 0.5, "active", 100)}


def install_states(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Catalogue items (kind, item_key, provider, source_ref) with `status` and how the version of the first matching
    inventory row (by device, position) relates to theirs; inventory is reduced to a row a tool before the join."""
    keys = ["kind", "item_key", "provider"]
    first = inventory.groupBy(*keys).agg(F.min_by(F.struct("version"), F.struct("device", "position")).alias("found"))
    plain = lambda v: F.regexp_replace(v, r"^v(?=\d)", "")
    version = F.nullif(F.col("found.version"), F.lit(""))
    relation = F.when(version.isNull(), "unknown").when(plain(version) == plain(F.col("source_ref")), "same").otherwise("different")
    found = F.col("found").isNotNull()
    return items.join(first, keys, "left").select(*items.columns, F.when(found, "installed").otherwise("not_installed").alias("status"), version.alias("version"), F.when(found, relation).alias("version_relation"))


def catalog_page(items: DataFrame, viewer: int, scope: str = "all", kind: str = "all", query: str = "") -> DataFrame:
    """Items of a scope (all, public, workspace, mine) and kind whose name or description has the query, case aside."""
    keep = {"public": F.col("origin") == "public", "workspace": F.col("origin") == "workspace", "mine": F.col("owner_user_id") == viewer}.get(scope, F.lit(True))
    if kind != "all":
        keep &= F.col("kind") == kind
    if query.strip():
        keep &= F.contains(F.lower(F.concat_ws("\n", "name", "description")), F.lit(query.strip().lower()))
    return items.where(keep)


def rollout_counts(policies: DataFrame, users: DataFrame, snapshots: DataFrame, reports: DataFrame) -> DataFrame:
    """Running policies with eligible devices of their team, and attempted and failed reports of their phase.

    Devices and reports are counted apart and then joined, so they never multiply; teams without users drop out."""
    devices = users.join(snapshots.groupBy("user_id").agg(F.countDistinct("snapshot_id").alias("n")), "user_id", "left").groupBy("team_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("eligible"))
    p = policies.where("enabled AND phase IN ('preflight', 'canary', 'expand')")
    met = p.select("policy_id", "seed", "version_id", "phase_started").join(reports, ["seed", "version_id"]).where("last_attempted_at >= phase_started")
    once = met.groupBy("policy_id", "report_id").agg(F.max(F.coalesce(F.col("status").isin("failed", "rolled_back"), F.lit(False))).alias("bad"))
    counts = once.groupBy("policy_id").agg(F.count("report_id").alias("attempted"), F.count_if("bad").alias("failed"))
    return p.join(devices, "team_id").join(counts, "policy_id", "left").select("policy_id", "phase", "phase_started", "eligible", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("attempted", "failed")])


def decided(counts: DataFrame, now: str) -> DataFrame:
    """The step of each rollout: rollback, advance (with the next phase and percentage) or hold."""
    failed, tried = F.col("failed"), F.col("attempted")
    minutes = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("phase_started")) / 60e6
    back = (failed >= MOST_FAILURES) | ((tried > 0) & (failed >= tried * MOST_FAILED_SHARE))
    action, phase, percent = F.when(back, "rollback"), F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for name, (least, share, then, reach) in PHASES.items():
        go = (F.col("phase") == name) & (minutes >= least) & (tried >= F.greatest(F.lit(1), F.ceil(F.col("eligible") * share)))
        action, phase, percent = action.when(go, "advance"), phase.when(~back & go, then), percent.when(~back & go, reach)
    return counts.withColumns({"action": action.otherwise("hold"), "next_phase": phase, "percent": percent})


def desired_tools(devices: DataFrame, preferences: DataFrame, chosen: DataFrame, policies: DataFrame) -> DataFrame:
    """What each device should have: a user's exclusion goes before their installation, that before the team's policy.

    devices (user_id, fingerprint, team_id), preferences (user_id, item, mode, scope, version_id), chosen (user_id, item,
    fingerprint: the devices of a preference), policies (team_id, item, version_id, seed, percent)."""
    wanted = devices.select("user_id", "fingerprint").join(preferences.where("mode = 'install' AND version_id IS NOT NULL"), "user_id")
    flagged = wanted.join(chosen.select("user_id", "item", "fingerprint", F.lit(True).alias("picked")).distinct(), ["user_id", "item", "fingerprint"], "left")
    own = flagged.where((F.col("scope") == "all_devices") | F.col("picked")).select("user_id", "fingerprint", "item", "version_id", F.lit("personal").alias("origin"))
    team = devices.join(policies, "team_id").where(X.fnv1a_percent(F.concat_ws(":", "seed", "fingerprint")) < F.col("percent")).select("user_id", "fingerprint", "item", "version_id", F.lit("team").alias("origin"))
    barred = preferences.where("mode = 'exclude'").select("user_id", "item")
    best = own.unionByName(team).join(barred, ["user_id", "item"], "left_anti").groupBy("user_id", "fingerprint", "item").agg(F.min_by(F.struct("version_id", "origin"), "origin").alias("r"))
    return best.select("user_id", "fingerprint", "item", "r.*")


def preference_devices(preferences: DataFrame, chosen: DataFrame) -> DataFrame:
    """Preferences with their devices in order; an empty list if there are none."""
    lists = chosen.where("fingerprint IS NOT NULL").groupBy("user_id", "item").agg(F.sort_array(F.collect_list("fingerprint")).alias("fingerprints"))
    return preferences.join(lists, ["user_id", "item"], "left").withColumn("fingerprints", F.coalesce("fingerprints", F.array().cast("array<string>")))


def device_states(snapshots: DataFrame, policies: DataFrame, observations: DataFrame, commands: DataFrame, now: str) -> DataFrame:
    """The latest snapshot of each device with its policy, observation and latest command, which may have expired."""
    keys = ["token", "fingerprint"]
    device = snapshots.groupBy(*keys).agg(F.max("received_at").alias("received_at"), F.max_by(F.struct(F.nullif("host", F.lit("")).alias("host")), F.struct("received_at", "snapshot_id")).alias("s"))
    late = F.col("command_status").isin("pending", "claimed") & (F.col("expires_at") <= F.lit(now).cast("timestamp"))
    last = commands.groupBy(*keys).agg(F.max_by(F.struct("command_id", "command_status", "expires_at"), F.struct("created_at", "command_id")).alias("c"))
    last = last.select(*keys, "c.*").withColumn("command_status", F.when(late, "expired").otherwise(F.col("command_status"))).drop("expires_at")
    return device.select(*keys, "s.host", "received_at").join(policies, keys, "left").join(observations, keys, "left").join(last, keys, "left")


def permission_diff(before: str, after: str) -> list[Column]:
    """Of two struct columns (env, hosts, components: arrays; source, command: text): what was added, what changed, and
    whether that needs approval."""
    added = {n: F.array_sort(F.array_except(F.col(f"{after}.{n}"), F.col(f"{before}.{n}"))) for n in ("env", "hosts", "components")}
    changed = {n: ~F.col(f"{after}.{n}").eqNullSafe(F.col(f"{before}.{n}")) for n in ("source", "command")}
    approval = changed["source"] | changed["command"]
    for c in added.values():
        approval |= F.size(c) > 0
    return [*[c.alias(f"added_{n}") for n, c in added.items()], *[c.alias(f"{n}_changed") for n, c in changed.items()], approval.alias("approval_required")]


def outdated(version: Column, current: Column) -> Column:
    """Below the current version; development builds and what isn't a version are never outdated."""
    a, b = X.semver_key(version), X.semver_key(current)
    zero = F.array(F.lit(0), F.lit(0), F.lit(0))
    return F.coalesce((a != zero) & (b != zero) & (a < b), F.lit(False))


def worst_versions(rows: DataFrame) -> DataFrame:
    """The lowest version of each user, by number and not by letter; what isn't a version is left out."""
    key = X.semver_key(F.col("version"))
    return rows.where(key.isNotNull()).groupBy("user_id").agg(F.min_by("version", F.struct(key.alias("k"), "version")).alias("version"))


def device_rows(inventory: DataFrame, devices: DataFrame) -> DataFrame:
    """Inventories (device, host) with the usage of their host (host, events), marked if they share it; then hosts with
    usage that have no inventory.  A null host is a host."""
    n = inventory.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    u = devices.select(F.col("host").alias("u_host"), "events").join(n.select(F.col("host").alias("n_host"), "n"), F.col("u_host").eqNullSafe(F.col("n_host")), "full")
    u = u.select(F.coalesce("n_host", "u_host").alias("k"), "events", "n")
    rows = inventory.join(u.where("n IS NOT NULL"), F.col("host").eqNullSafe(F.col("k")), "left").select("device", "host", "events", (F.col("n") > 1).alias("shared"))
    rest = u.where("n IS NULL").select(F.lit(None).cast(dict(inventory.dtypes)["device"]).alias("device"), F.col("k").alias("host"), "events", F.lit(False).alias("shared"))
    return rows.unionByName(rest)
