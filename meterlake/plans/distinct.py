"""Exact distinct counts that merge: a rollup without a row for each session.

Sessions and users get numbers, in the order of the hours in which they were seen first, so what is active together has
numbers close together.  A rollup keeps two tables: the sums of each cell, and the sets of numbers of each cell in chunks of
32,768.  A chunk with few members is an array of places, one with more a bitmap; sets of any cells are united by bits, so
a period, a zone's days or a moving window has the count that the raw events have.

Values that have no number yet were in no cell, so they are counted beside.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: What is counted.
COUNTED = ["sessions", "active_users"]
#: Members of a chunk up to which its set is an array of places (2 bytes each, against a bitmap's 4,096).
FEW = 1024
#: Parts of an hour's new values that are numbered apart, so that no hour is one task.
SLICES = 16
SUMS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]
EVENTS = ["priced_events", "unpriced_events", "legacy_events"]


def members(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """The columns to keep, `of` (a measure) and `value`: a row for each value that counts in an event."""
    values = (F.nullif("session_id", F.lit("")), F.col("user_id").cast("string"))
    pairs = F.array(*[F.struct(F.lit(k).alias("of"), v.alias("value")) for k, v in zip(COUNTED, values)])
    return rows.select(*keep, F.explode(pairs).alias("m")).select("*", "m.*").drop("m").where("value IS NOT NULL")


def numbered(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """of, value, number: the values of events that `known` (a table of this form) hasn't got, from its largest number on
    without gaps.  Counts of hours and slices, 384 rows a day, are summed in one task; the values are numbered in many."""
    hour, part = X.bucket_start("ts", 60).alias("hour"), F.pmod(F.xxhash64("value"), F.lit(SLICES)).alias("part")
    new = members(events, hour).groupBy("of", "value").agg(F.min("hour").alias("hour")).select("*", part)
    begin = F.lit(0)
    if known is not None:
        # Few of the known values are in a batch, so it is those that meet it: known is scanned, not shuffled, if the batch is small.
        there = known.select("of", "value").join(new.select("of", "value"), ["of", "value"], "left_semi")
        new = new.join(there, ["of", "value"], "left_anti")
        for k, n in known.groupBy("of").agg(F.max("number")).collect():  # a row a measure
            begin = F.when(F.col("of") == k, n).otherwise(begin)
    size = new.groupBy("of", "hour", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("hour", "part")) - F.col("n")
    base = size.select("of", "hour", "part", (before + begin).alias("base"))
    place = F.row_number().over(Window.partitionBy("of", "hour", "part").orderBy("value"))
    return new.withColumn("place", place).join(base, ["of", "hour", "part"]).select("of", "value", (F.col("base") + F.col("place")).alias("number"))


def totals(events: DataFrame, **by: Column | str) -> DataFrame:
    """The sums of each cell; unpriced cost counts nothing."""
    cost = F.sum(F.when(F.col("cost_status") != "unpriced", F.col("cost_usd")).otherwise(0)).cast("decimal(28,8)").alias("cost_usd")
    return events.groupBy(*_named(by)).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS], cost, *X.coverage())


def sets(events: DataFrame, numbers: DataFrame, **by: Column | str) -> DataFrame:
    """The sets of each cell: by, of, chunk, few (places) or bits.  Values without a number are left out."""
    cells = members(events, *_named(by)).distinct().join(numbers, ["of", "value"])
    key = [*by, "of", "chunk"]
    held = cells.select(*by, "of", F.bitmap_bucket_number("number").alias("chunk"), F.bitmap_bit_position("number").cast("short").alias("place"))
    held = held.groupBy(*key).agg(F.collect_set("place").alias("few"))  # 32,768 members at most
    return packed(held.withColumn("bits", F.lit(None).cast("binary")), key)


def packed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Arrays that are too long become bitmaps."""
    long = F.coalesce(F.size("few") > FEW, F.lit(False))
    built = rows.where(long).select(*key, F.explode("few").alias("place")).groupBy(*key).agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    return rows.where(~long).select(*key, "few", "bits").unionByName(built.select(*key, F.lit(None).cast("array<smallint>").alias("few"), "bits"))


def united(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, of, chunk, bits: one bitmap for each chunk of all cells with a key."""
    key = [*key, "of", "chunk"]
    few = cells.where("bits IS NULL").select(*key, F.explode("few").alias("place")).groupBy(*key).agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    return few.unionByName(cells.where("bits IS NOT NULL").select(*key, "bits")).groupBy(*key).agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(cells: DataFrame, *key: str) -> DataFrame:
    """key and a column for each measure: how many members all cells with a key have together."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("of") == k, F.bitmap_count("bits"))), F.lit(0)).cast("long").alias(k)
    return united(cells, list(key)).groupBy(*key).agg(*[of(k) for k in COUNTED])


def unnumbered(events: DataFrame, numbers: DataFrame, **by: Column | str) -> DataFrame:
    """by and a column for each measure: the values of raw events that have no number."""
    new = members(events, *_named(by)).join(numbers.select("of", "value"), ["of", "value"], "left_anti")
    of = lambda k: F.countDistinct(F.when(F.col("of") == k, F.col("value"))).alias(k)
    return new.groupBy(*by).agg(*[of(k) for k in COUNTED])


def measured(cells: DataFrame, cell_sets: DataFrame, beside: DataFrame | None = None, **by: Column | str) -> DataFrame:
    """The measures of a dashboard, with coverage, by expressions over the cells' keys; beside: unnumbered() by the same."""
    key = list(by)
    sums = cells.groupBy(*_named(by)).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double"), 4).alias("cost"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in [*SUMS, *EVENTS]])
    found = counts(cell_sets.select(*_named(by), "of", "chunk", "few", "bits"), *key)
    if beside is not None:
        found = found.unionByName(beside).groupBy(*key).agg(*[F.sum(k).alias(k) for k in COUNTED])
    right = found.select(*[F.col(k).alias(f"of_{k}") for k in key], *COUNTED)
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key], F.lit(True))
    return sums.join(right, on, "left").select(*key, *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in COUNTED], *[c for c in sums.columns if c not in key])


def _named(by: dict[str, Column | str]) -> list[Column]:
    return [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in by.items()]
