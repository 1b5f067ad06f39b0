"""Line deduplication over overlapping windows of consecutive lines, in DataFrame functions only.

Every window of three consecutive lines is hashed (128 bits).  A window whose lines occur more than once, anywhere, keeps
its first occurrence, by document and place; every later occurrence covers its lines, covered places are merged, and
covered lines go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, stored, without


def drop_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, separator: str = "\n") -> DataFrame:
    """df with the text shortened, `n_lines` (long, lines before) and `n_removed` (long).

    First means the smallest (id, hash of the text, place), null ids first.  Rows with the same id and text are one
    document to this operator: they get the same text.  A null text stays null and has no lines; an empty text is one
    empty line; texts of fewer lines than a window are left alone.  A text that loses all its lines becomes empty; a very
    long text is one array of lines and of their hashes.  The separator is taken as it is.  Repeated rows repeat; an empty
    table gives an empty one.  Other columns pass through, whatever their names; those named n_lines or n_removed are
    replaced, unless it is the id or the text, which can't have these names.
    """
    if {id_col.lower(), text_col.lower()} & {"n_lines", "n_removed"}:
        raise ValueError("the id and the text can't be named n_lines or n_removed")
    df = without(df, "n_lines", "n_removed")
    lines, text_hash, drop, its_id, its_hash = fresh(df.columns, "lines", "text_hash", "drop_places", "covered_id", "covered_hash")
    separate = lambda column: F.split(column, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    docs = df.withColumn(text_hash, F.xxhash64(quoted(text_col)))
    cut = docs.select(quoted(id_col).alias("id"), quoted(text_hash).alias("th"), separate(quoted(text_col)).alias("l"))
    part = [f"l[i + {k}]" for k in range(window)]
    hashed = F.expr(f"transform(sequence(0, size(l) - {window}), i -> struct(xxhash64({', '.join(part)}) as h1, xxhash64(7L, {', '.join(reversed(part))}) as h2))")
    windows = cut.where(F.size("l") >= window).select("id", "th", F.posexplode(hashed).alias("at", "w")).select("id", "th", "at", "w.h1", "w.h2")
    windows = stored(windows, "line-windows")
    # Partial aggregation meets a window that fills a third of all rows before the exchange does.
    repeated = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = stored(repeated, "line-repeats")
    # Both sides come from tables, so the adaptive planner may split a hot window of the left side over tasks.
    later = windows.join(repeated, ["h1", "h2"]).where(~F.struct("id", "th", "at").eqNullSafe(F.col("first")))
    later = later.select("id", "th", "at").groupBy("id", "th").agg(F.collect_set("at").alias("starts"))
    covered = later.select(F.col("id").alias(its_id), F.col("th").alias(its_hash), F.flatten(F.transform("starts", lambda p: F.sequence(p, p + window - 1))).alias(drop))
    out = docs.join(covered, quoted(id_col).eqNullSafe(quoted(its_id)) & (quoted(text_hash) == quoted(its_hash)), "left").drop(its_id, its_hash)
    out = out.withColumn(lines, separate(quoted(text_col)))
    places = F.array_except(F.sequence(F.lit(0), F.size(quoted(lines)) - 1), quoted(drop))
    kept = F.when(quoted(drop).isNull(), quoted(text_col)).otherwise(F.array_join(F.transform(places, lambda p: quoted(lines)[p]), separator))
    out = out.withColumn("n_lines", F.coalesce(F.size(quoted(lines)), F.lit(0)).cast("long"))
    out = out.withColumn("n_lines", F.when(quoted(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    out = out.withColumn("n_removed", F.coalesce(F.size(F.array_distinct(quoted(drop))), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.when(quoted(drop).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_removed")))
    return out.withColumn(text_col, kept).drop(lines, text_hash, drop)


def oracle(window: int = 3) -> str:
    """The same result over `documents` in DuckDB's SQL, by whole window texts."""
    lines = ", ".join(f"l[i + {k}]" for k in range(window))
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT DISTINCT doc_id, text, l FROM d),
w AS (SELECT doc_id, text, i, [{lines}] AS k FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - {window - 2})) AS i FROM u WHERE len(l) >= {window})),
r AS (SELECT doc_id, text, i, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, text, i) AS rn FROM w),
c AS (SELECT DISTINCT doc_id, text, i + o AS p FROM r, (SELECT unnest(range(0, {window})) AS o) WHERE rn > 1),
x AS (SELECT doc_id, text, list(p) AS ps FROM c GROUP BY doc_id, text)
SELECT d.doc_id AS doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(d.l) END::BIGINT AS n_lines,
  coalesce(len(x.ps), 0)::BIGINT AS n_removed,
  CASE WHEN x.ps IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(1, len(d.l) + 1), lambda p: NOT list_contains(x.ps, p)), lambda p: d.l[p]), chr(10)) END AS text
FROM d LEFT JOIN x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text"""
