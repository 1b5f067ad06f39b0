"""Ordered scans that are cut anywhere: what a line needs from the lines before it, without one task for a whole file.

Files are read by byte ranges, so a file has as many segments as tasks read it, and a line is placed by its segment and by
its place there.  A first pass leaves a row for each segment: its number of lines and the last of every hint in it.  These
few rows are scanned in order of the segments, which gives each segment what it starts from; then segments go on alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

#: Of rows that have a place of their own, 2 to this power are a segment.
SEGMENT_BITS = 16


def lines_below(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """file, modified, segment, place and value of every line of the files below a folder, empty ones included.

    Lines end at a line feed.  A segment is the byte range that one task reads; place rises within it.  Both hold for one
    reading of the files, so what needs them twice writes its rows in between, as carried() does.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    meta = lambda c: F.col(f"_metadata.file_{c}")
    return files.select(meta("path").alias("file"), meta("modification_time").alias("modified"), meta("block_start").alias("segment"), F.monotonically_increasing_id().alias("place"), "value")


def carried(rows: DataFrame, by: str = "file", order: str = "line", last: Sequence[str] = (), before: Mapping[str, str] | None = None, counts: Mapping[str, str] | None = None, bits: int | None = None) -> DataFrame:
    """rows with, in order within each value of `by`: each column of `last` replaced by its last value so far that isn't
    null; for each name of `before` the last such value of a column before the own row; for each name of `counts` how many
    rows so far have a value in a column.

    rows are lines as lines_below() gives them, which get their number as `line` (from 0, empty lines included), or have an
    `order` column of whole numbers, unique within `by`.  Rows of one key are spread over tasks by segments of 2 to the power
    of bits places.
    """
    before, counts = dict(before or {}), dict(counts or {})
    read = "segment" in rows.columns
    # The scan's segments hold for one reading only, so these rows are written before they are used twice.
    rows = written(rows) if read else rows.withColumns({"segment": F.shiftright(F.col(order).cast("long"), SEGMENT_BITS if bits is None else bits), "place": F.col(order).cast("long")})
    hints = [*last, *before.values()]
    final = {f"final_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))) for c in dict.fromkeys(hints)}
    numbers = {f"count_{n}": F.count(c) for n, c in counts.items()}
    summary = rows.groupBy(by, "segment").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("lines"), *[e.alias(c) for c, e in (final | numbers).items()])
    earlier = Window.partitionBy(by).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = {c: F.last(c, True).over(earlier) for c in final} | {c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in [*numbers, "lines"]}
    start = summary.select(F.col(by).alias("started"), F.col("segment").alias("at"), "first_place", *[e.alias(c) for c, e in start.items()])
    within = Window.partitionBy(by, "segment").orderBy("place")
    up_to, ahead = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(start, F.col(by).eqNullSafe(F.col("started")) & (F.col("segment") == F.col("at")))
    new = {c: F.coalesce(F.last(c, True).over(up_to), f"final_{c}") for c in last}
    new |= {n: F.coalesce(F.last(c, True).over(ahead), f"final_{c}") for n, c in before.items()}
    new |= {n: F.count(c).over(up_to) + F.col(f"count_{n}") for n, c in counts.items()}
    if read:
        new["line"] = F.col("lines") + F.col("place") - F.col("first_place")
    return met.withColumns(new).drop("started", "at", "first_place", "lines", "segment", "place", *final, *numbers)


def numbered(rows: DataFrame) -> DataFrame:
    """Lines as lines_below() gives them with their number in the file, from 0."""
    return carried(rows)
