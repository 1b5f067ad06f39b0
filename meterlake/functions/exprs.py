"""Column expressions that the queries share: token totals, priced cost, coverage, wall-clock labels, prices, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TIER_TOKENS = 200_000


def total_tokens() -> Column:
    return F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")


def js_round(x: Column) -> Column:
    """Half up toward plus infinity."""
    return F.floor(x + 0.5)


def priced_cost(digits: int = 4) -> Column:
    """Sum of cost without unpriced events, zero if there is none."""
    s = F.sum(F.when(F.col("cost_status") != "unpriced", F.col("cost_usd")))
    return F.round(F.coalesce(s.cast("double"), F.lit(0.0)), digits)


def total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long")


def coverage() -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("cost_status") == s, F.col("event_count"))), F.lit(0)).cast("long").alias(f"{s}_events") for s in ("priced", "unpriced", "legacy")]


def tokens() -> list[Column]:
    return [total(f"{x}_tokens").alias(f"{x}_tokens") for x in ("input", "output", "cache_read", "cache_creation")]


def measures(with_coverage: bool = True) -> list[Column]:
    """Exact distinct sessions (null and empty aside) and users, cost, tokens and, if asked for, cost coverage."""
    out = [F.countDistinct(F.nullif("session_id", F.lit(""))).alias("sessions"), F.countDistinct("user_id").alias("active_users"), priced_cost().alias("cost"), *tokens()]
    return out + (coverage() if with_coverage else [])


def local(ts: Column | str, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def bucket_label(ts: Column | str, zone: str, bucket: str = "day") -> Column:
    """Wall-clock label; the repeated hour of an autumn day falls into one bucket."""
    at = local(ts, zone)
    if bucket == "day":
        return F.date_format(at, "yyyy-MM-dd")
    if bucket == "hour":
        return F.date_format(at, "yyyy-MM-dd HH:00")
    width = {"30m": 30, "15m": 15}[bucket]
    floor = F.floor(F.minute(at) / width) * width
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:"), F.lpad(floor.cast("string"), 2, "0"))


def bucket_start(ts: Column | str, minutes: int = 15) -> Column:
    """UTC tumbling bucket."""
    seconds = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts) / seconds) * seconds)


def tiered(n: Column, base: Column, above: Column) -> Column:
    """Price of n tokens in dollars; above 200,000 the second price holds, if there is one."""
    over = F.greatest(n - TIER_TOKENS, F.lit(0))
    return F.when(above.isNull() | (n <= TIER_TOKENS), n * base).otherwise((n - over) * base + over * above) / 1e6


def token_cost(one_hour: Column | None = None, fast: Column | None = None) -> Column:
    """Cost of a row with token counts and the prices input, output, cache_read, cache_creation, input_above, output_above, fast."""
    c = F.col
    hour = F.least(one_hour if one_hour is not None else F.lit(0), c("cache_creation_tokens"))
    cost = (
        tiered(c("input_tokens"), c("input"), c("input_above"))
        + tiered(c("output_tokens"), c("output"), c("output_above"))
        + c("cache_read_tokens") * F.coalesce("cache_read", c("input") * 0.1) / 1e6
        + (c("cache_creation_tokens") - hour) * F.coalesce("cache_creation", c("input") * 1.25) / 1e6
        + hour * c("input") * 2 / 1e6
    )
    return cost if fast is None else F.when(fast, cost * F.coalesce("fast", F.lit(1.0))).otherwise(cost)


def coverage_state(priced: Column, unpriced: Column, legacy: Column) -> Column:
    return F.when((unpriced > 0) & (priced + legacy > 0), "partial").when(unpriced > 0, "unpriced").when((legacy > 0), "legacy").otherwise("complete")


def percent_delta(current: Column, previous: Column) -> Column:
    """Rounded percent, null without a previous value or at zero, within 999 either way."""
    p = js_round((current - previous) / previous * 100)
    return F.when((previous > 0) & (p != 0), F.greatest(F.lit(-999), F.least(F.lit(999), p))).cast("long")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f uses it, also within a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def array_median(values: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return once(F.sort_array(values), middle)


def nearest_rank(values: Column, share: float) -> Column:
    s = F.sort_array(values)
    return F.get(s, F.floor((F.size(s) - 1) * share + 0.5).cast("int"))


def deviation_score(current: Column, center: Column, spread: Column, direction: int = 1) -> Column:
    """0 to 100: 50 at the center, 15 for each scaled spread (0.05 at least)."""
    raw = js_round(F.lit(50) + 15 * direction * ((current - center) / F.greatest(spread * 1.4826, F.lit(0.05))))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long")


def baseline_score(current: Column, baseline: Column, direction: int = 1) -> Column:
    """The score against the baseline's median and its median deviation from that."""
    spread = lambda center: array_median(F.transform(baseline, lambda v: F.abs(v - center)))
    return once(array_median(baseline), lambda center: deviation_score(current, center, spread(center), direction))


def semver_key(version: Column) -> Column:
    """The three numbers of a version, a leading v aside; null if it isn't one."""
    plain = F.regexp_replace(version, "^v", "")
    return F.when(plain.rlike(r"^\d+\.\d+\.\d+"), F.transform(F.split(F.regexp_extract(plain, r"^(\d+\.\d+\.\d+)", 1), r"\."), lambda x: x.cast("int")))


def fnv1a_percent(text: Column) -> Column:
    """FNV-1a (32 bits) of the UTF-8 bytes, modulo 100, in SQL functions."""
    data = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.length(data) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substring(data, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.length(data) == 0, F.array().cast("array<bigint>")).otherwise(codes)
    mask = F.lit(0xFFFFFFFF).cast("long")
    return F.pmod(F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(mask)), F.lit(100)).cast("int")


def dedup_key() -> Column:
    """Of a row with request_id, model, session_id, sequence, ts_ms and token counts."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    counts = [F.col(f"{x}_tokens").cast("string") for x in ("input", "output", "cache_read", "cache_creation")]
    by_request = F.concat_ws("|", F.lit("req"), F.col("request_id"), text("model"), *counts)
    natural = F.concat_ws("|", F.lit("nat"), text("session_id"), text("sequence"), F.col("ts_ms").cast("string"), *counts)
    return F.sha2(F.when(F.nullif("request_id", F.lit("")).isNotNull(), by_request).otherwise(natural), 256)


def collector_key(adapter: Column) -> Column:
    """Of a row read from files, with message_id, model, session_id, ts_ms and token counts."""
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    counts = [F.col(f"{x}_tokens").cast("string") for x in ("input", "output", "cache_read", "cache_creation")]
    by_id = F.concat_ws(":", adapter, F.col("message_id"), text("model"), *counts)
    natural = F.concat_ws(":", adapter, text("session_id"), F.col("ts_ms").cast("string"), text("model"), *counts[:2])
    return F.sha2(F.when(F.col("message_id").isNotNull(), by_id).otherwise(natural), 256)


def share_percent(part: Column, whole: Column) -> Column:
    """Rounded percent, null of nothing."""
    return F.when(whole > 0, js_round(part / whole * 100)).cast("long")


def bar_width(value: Column, largest: Column) -> Column:
    """Percent of the largest, 3 at least; zero if the largest is none."""
    return F.when(largest > 0, F.greatest(F.lit(3), js_round(value / largest * 100))).otherwise(0).cast("long")


def clean_host(host: Column) -> Column:
    """Control characters and outer blanks go, 255 characters stay, empty becomes null."""
    return F.nullif(F.trim(F.substring(F.trim(F.regexp_replace(host, r"[\x00-\x1f\x7f]", "")), 1, 255)), F.lit(""))


def utc_month(ts: Column) -> Column:
    """The month of an instant in UTC, whatever the session's zone: what facts are partitioned by."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")


def first_instant(day: Column, zone: Column) -> Column:
    """The first instant that exists on a local date, in UTC as a timestamp without zone, also where midnight is skipped."""
    return F.to_utc_timestamp(F.to_timestamp_ltz(F.concat(day.cast("string"), F.lit(" 00:00:00 UTC"))), zone).cast("timestamp_ntz")


def model_name(model: Column) -> Column:
    """How a model is shown to people, null if its maker's names aren't known.  A name is a maker and parts between hyphens:
    one family, which is a word, before or after the numbers of the version, and perhaps a date at the end."""
    parts = F.split(model, "-")
    maker, rest = parts[0], F.slice(parts, 2, 1 << 20)
    number, word = (lambda x: F.rlike(x, F.lit(r"^\d+$"))), (lambda x: F.rlike(x, F.lit("^[a-z]+$")))
    dated = (F.size(rest) == 4) & F.rlike(F.element_at(rest, -1), F.lit(r"^\d{8}$"))
    kept = F.when(dated, F.slice(rest, 1, 3)).otherwise(rest)
    family, version = F.filter(kept, word), F.filter(kept, number)
    whole = (F.size(family) == 1) & (F.size(family) + F.size(version) == F.size(kept))
    placed = (word(F.get(kept, F.lit(0))) & F.size(version).between(1, 2)) | (word(F.get(kept, F.lit(2))) & (F.size(version) == 2))
    title = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))
    variant = F.slice(parts, 3, 1 << 20)
    known = F.rlike(F.get(parts, F.lit(1)), F.lit(r"^\d+(\.\d+)?$")) & F.rlike(F.array_join(variant, "-"), F.lit("^[a-z][a-z-]*$"))
    return (
        F.when((maker == "claude") & whole & placed, F.concat_ws(" ", F.lit("Claude"), F.initcap(family[0]), F.array_join(version, ".")))
        .when((maker == "gemini") & known, F.concat_ws(" ", F.lit("Gemini"), F.get(parts, F.lit(1)), F.array_join(F.transform(variant, title), " ")))
        .when(model.startswith("gpt-"), F.concat(F.lit("GPT-"), F.substring(model, 5, 1 << 20)))
    )


#: Tags with which tools begin what they put in place of a prompt.
META_TAGS = ["local-command-caveat", "local-command-stdout", "local-command-stderr", "command-name", "command-message", "command-args", "system-reminder", "task-notification", "user-memory-input"]


def is_meta(text: Column) -> Column:
    """Whether a user turn was put there by a tool."""
    return F.coalesce(text.rlike(r"^\s*<(?:" + "|".join(META_TAGS) + r")[\s>]"), F.lit(False))


def meta_command(text: Column, blank: str = r"\s") -> Column:
    """The command, with its arguments, that a tool's turn calls, without blanks around either; null for any other turn."""
    inside = lambda tag: F.nullif(F.regexp_extract(text, rf"<{tag}>{blank}*([^<]*?){blank}*</{tag}>", 1), F.lit(""))
    name, args = inside("command-name"), inside("command-args")
    return F.when(is_meta(text), F.when(args.isNull(), name).otherwise(F.concat(name, F.lit(" "), args)))


def usd(amount: Column) -> Column:
    """An amount as people read it: $1,234.50."""
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def compact_number(n: Column) -> Column:
    """A count in at most four figures: 999, 1.2K, 35M, 1.5B, 2T."""
    out = F.lit(None).cast("string")
    tidy = lambda x: F.regexp_replace(F.format_number(x, 1), r"\.0$", "")
    for size, sign in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"), (1.0, "")):
        share = F.round(n / size, 1)
        out = F.coalesce(out, F.when(share >= 1, F.concat(tidy(share), F.lit(sign))))
    return F.coalesce(out, tidy(n))
