"""Session history over turns (session, turn, role, text): groups, previews, runs, matching with usage."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNIPPET = 200
#: Letters of a snippet of a search; positions of a trigram's hash.
FOUND, TRIGRAM_BITS = 220, 1 << 20
#: Milliseconds of a session that one task orders, as a power of two: about 70 minutes.
TIME_BITS = 22
#: What comes before a request, and what attachments leave in a text.
REQUEST = r"(?is)^.*?(?:^|\n)#{1,6}\s*My request for [^:\n]+:\s*"
ATTACHED = [
    r"(?i)<image\b[\s\S]*?</image>",
    r"(?i)<image\b[^>]*>",
    r"(?im)^\s*#{1,6}\s*files? mentioned by the user:\s*$",
    r"(?im)^\s*#{1,6}\s+(?:[\w.-]+-)?(?:codex-clipboard|claude-clipboard)[^\n]*$",
]


def cleaned(text: Column, size: int = SNIPPET) -> Column:
    """The request within a text, without attachments, on one line; a longer one is cut and marked."""
    body = F.regexp_replace(text, REQUEST, "")
    for p in ATTACHED:
        body = F.regexp_replace(body, p, " ")
    line = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size), F.lit("…"))).otherwise(line)


def groups(turns: DataFrame, requests: bool = False) -> DataFrame:
    """Sessions with their first user turn (else the first turn) as a preview: blanks folded and cut to 200 characters, or
    the request within it."""
    pick = F.min_by("text", F.struct((F.col("role") != "user").alias("a"), "turn"))
    text = cleaned(pick, SNIPPET - 1) if requests else F.trim(F.regexp_replace(pick, r"\s+", " "))
    return turns.groupBy("session").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles"), F.bool_or(F.col("role") == "assistant").alias("answered"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.substring(text, 1, SNIPPET).alias("preview"))


def page(sessions: DataFrame, before: tuple[int, int] | None, size: int) -> DataFrame:
    """Keyset page by last turn and session, newest first, one row more than the page to tell whether there is another."""
    p = sessions if before is None else sessions.where((F.col("last_turn") < before[0]) | ((F.col("last_turn") == before[0]) & (F.col("session") < before[1])))
    return p.orderBy(F.desc("last_turn"), F.desc("session")).limit(size + 1)


def search(turns: DataFrame, words: str) -> DataFrame:
    """The first turn of each session that holds the words, case folded, with a snippet around them."""
    at = F.locate(words.lower(), F.lower("text"))
    hits = turns.where(F.lower("text").contains(words.lower())).withColumn("snippet", F.substring(F.col("text"), F.greatest(at - 40, F.lit(1)), F.lit(120)))
    return hits.groupBy("session").agg(F.min_by(F.struct("turn", "role", "snippet"), "turn").alias("t")).select("session", "t.turn", "t.role", "t.snippet")


def trigram_bits(turns: DataFrame, *by: str) -> DataFrame:
    """by, bucket and bits: bitmaps of the hashes of all three-letter stretches of the texts, case folded, for each group."""
    low = F.lower("text")
    stretches = F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))
    at = turns.select(*by, F.explode(stretches).alias("t")).select(*by, F.pmod(F.xxhash64("t"), F.lit(TRIGRAM_BITS)).alias("at"))
    return at.groupBy(*by, F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def may_hold(index: DataFrame, words: str, by: str) -> DataFrame:
    """Groups of the index (by, bucket, bits; several rows of a group count together) whose texts may hold the words: all that
    do, and a few others.  Words under three letters rule out none."""
    low = words.lower()
    marks = index.sparkSession.createDataFrame([(low[i : i + 3],) for i in range(len(low) - 2)], "t string").distinct()
    at = F.pmod(F.xxhash64("t"), F.lit(TRIGRAM_BITS))
    marks = marks.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).distinct()
    if len(low) < 3:
        return index.select(by).distinct()
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = index.join(marks, "bucket").where(F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(1) == 1)
    n = marks.count()  # of one question's words
    return held.select(by, "bucket", "bit").distinct().groupBy(by).count().where(F.col("count") == n).select(by)


def hits(turns: DataFrame, words: str) -> DataFrame:
    """Turns that hold the words, case folded, with a snippet of FOUND letters around them."""
    at = F.locate(words.lower(), F.lower("text"))
    around = F.substring(F.col("text"), F.greatest(at - (FOUND - len(words)) // 2, F.lit(1)), F.lit(FOUND))
    return turns.where(F.lower("text").contains(words.lower())).withColumn("snippet", around).select("session", "turn", "role", "snippet")


def runs(turns: DataFrame, agent: str = "agent") -> DataFrame:
    """Runs of consecutive turns by agents: an island for each stretch between turns of the main thread, a row per agent in it."""
    w = Window.partitionBy("session").orderBy("turn")
    tagged = turns.withColumn("island", F.sum(F.when(F.col(agent).isNull(), 1).otherwise(0)).over(w))
    return tagged.where(F.col(agent).isNotNull()).groupBy("session", "island", agent).agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def islands(rows: DataFrame, tolerance_ms: int) -> DataFrame:
    """rows (session, ts_ms and more) with `island`, the time at which the island that a row is in begins; rows without a
    session or a time go.

    Tasks order stretches of a session of 2 to the power of TIME_BITS milliseconds.  A stretch that an island enters from
    before gets its beginning from a row for each stretch, and these few are ordered within the session.
    """
    ts, by = F.col("ts_ms").cast("long"), ["session", "stretch"]
    rows = rows.where("session IS NOT NULL AND ts_ms IS NOT NULL").withColumn("stretch", F.shiftright(ts, TIME_BITS))
    within = Window.partitionBy(*by).orderBy("ts_ms")
    begins = F.when(ts - F.lag(ts).over(within) > tolerance_ms, ts)
    times = rows.select(*by, "ts_ms").withColumn("begins", begins).groupBy(*by).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.max("begins").alias("inner"))
    earlier = Window.partitionBy("session").orderBy("stretch")
    before = F.lag("last").over(earlier)
    entered = times.withColumn("own", F.when(before.isNull() | (F.col("first") - before > tolerance_ms), F.col("first")))
    carried = F.last(F.coalesce("inner", "own"), True).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    entered = entered.select(F.col("session").alias("s"), F.col("stretch").alias("at"), F.coalesce("own", carried).alias("entered"))
    placed = rows.withColumn("begins", begins).withColumn("island", F.last("begins", True).over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    met = placed.join(entered, (F.col("session") == F.col("s")) & (F.col("stretch") == F.col("at")))
    return met.withColumn("island", F.coalesce("island", "entered")).drop("stretch", "begins", "s", "at", "entered")


def matched(turns: DataFrame, usage: DataFrame, tolerance_ms: int = 10_000) -> DataFrame:
    """Greedy: the assistant turns of a session in order each take the nearest usage event not yet taken, within the tolerance.

    turns: session, key, ts_ms, assistant turns only.  usage: session, event, ts_ms.  Where neighbouring times of a session
    are further apart than the tolerance nothing is taken across, so these islands are worked on each for itself, and a
    session of any length is spread over tasks.  A task takes its islands one after the other from sorted rows, the events
    of each before its turns, and holds the events of one.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = usage.select("session", "ts_ms", F.lit(False).alias("turn"), "event", none(turns, "key")).union(turns.select("session", "ts_ms", F.lit(True), none(usage, "event"), "key"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def free(to: list[int], i: int) -> int:
            while to[i] != i:
                to[i] = to[to[i]]
                i = to[i]
            return i

        on = None
        for b in batches:
            out = []
            for session, island, turn, ts, event, name in zip(*[c.to_pylist() for c in b.columns]):
                if on is None or island != on[1] or session != on[0]:
                    on, at, events, after = (session, island), [], [], None
                if not turn:
                    at.append(ts)
                    events.append(event)
                    continue
                if after is None:  # the next free event from here on, and (by place + 1) up to here
                    n = len(at)
                    after, before = list(range(n + 1)), list(range(n + 1))
                place = bisect_left(at, ts)
                right, left = free(after, place), free(before, place) - 1
                best = None
                if left >= 0:
                    best = free(after, bisect_left(at, at[left]))  # the first free one of that time
                if right < n and (best is None or at[right] - ts < ts - at[best]):
                    best = right
                if best is not None and abs(at[best] - ts) <= tolerance_ms:
                    after[best], before[best + 1] = best + 1, best
                    out.append((session, name, events[best]))
            kinds = [b.schema.field(c).type for c in ("session", "key", "event")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 3, kinds)], ["session", "key", "event"])

    placed = islands(rows, tolerance_ms).select("session", "island", "turn", "ts_ms", "event", "key")
    ordered = placed.repartition("session", "island").sortWithinPartitions("session", "island", "turn", "ts_ms", F.asc_nulls_last("event"), F.asc_nulls_last("key"))
    kinds = {c: placed.schema[c].dataType.simpleString() for c in ("session", "key", "event")}
    return ordered.mapInArrow(greedy, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def normalised(df: DataFrame, column: str) -> DataFrame:
    """Unicode NFKC, which Spark has no function for, in Arrow batches."""
    import unicodedata

    @F.pandas_udf("string")
    def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return df.withColumn(column, nfkc(F.col(column)))
