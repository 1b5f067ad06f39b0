"""Named queries over rollups whose distinct counts merge: days of a zone, moving weeks, and rollups with raw events after them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import exprs as X
from .plans import distinct
from .queries import SEOUL, SHORT, YORK, M, label, query
from .sources import tables as T


def _cell():
    return {"bucket": X.bucket_start("ts"), "provider_key": "provider_key"}


@query("agg20_distinct_cells", f"WITH {T.EV} SELECT {label(SEOUL)} AS day, provider_key, {M} FROM ev GROUP BY 1, 2")
def _(spark, d):
    """A zone's days by provider, from cells of 15 minutes and provider that keep no session."""
    e = T.usage_events(spark, d)
    cells, sets = distinct.totals(e, **_cell()), distinct.sets(e, distinct.numbered(e), **_cell())
    return distinct.measured(cells, sets, day=X.bucket_label("bucket", SEOUL), provider_key="provider_key")


@query("agg21_moving_week", f"""WITH {T.EV}, e AS (SELECT *, {label(YORK)}::DATE AS day FROM ev), days AS (SELECT DISTINCT day FROM e)
SELECT strftime(days.day, '%Y-%m-%d') AS day, {SHORT}, {', '.join(f"count(*) FILTER (WHERE cost_status = '{s}') AS {s}_events" for s in ("priced", "unpriced", "legacy"))} FROM days JOIN e ON e.day BETWEEN days.day - 6 AND days.day GROUP BY days.day""")
def _(spark, d):
    """Sessions, users and sums of the seven local days up to each day that has events: sets of days are united seven times,
    events are read once."""
    e = T.usage_events(spark, d)
    day = {"day": F.to_date(X.bucket_label("ts", YORK))}
    cells, sets = distinct.totals(e, **day), distinct.sets(e, distinct.numbered(e), **day)
    spread = lambda df: df.withColumn("last", F.explode(F.sequence("day", F.date_add("day", 6))))
    weeks = distinct.measured(spread(cells), spread(sets), day=F.date_format("last", "yyyy-MM-dd"))
    return weeks.join(cells.select(F.date_format("day", "yyyy-MM-dd").alias("day")), "day", "left_semi")


@query("src5_distinct_stitched", f"WITH {T.EV} SELECT provider_key, {M} FROM ev GROUP BY 1")
def _(spark, d):
    """Cells up to an instant and raw events after it.  The second half of the cells has numbers that go on from the first's;
    raw sessions without a number are counted beside."""
    e = T.usage_events(spark, d)
    part = lambda a, b: e.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")))
    first, second, raw = part("1970-01-01", "2024-01-12"), part("2024-01-12", "2024-01-20 06:30:00"), part("2024-01-20 06:30:00", "9999-01-01")
    numbers = distinct.numbered(first)
    numbers = numbers.unionByName(distinct.numbered(second, numbers))
    rolled = first.unionByName(second)
    cells = distinct.totals(rolled, **_cell()).unionByName(distinct.totals(raw, **_cell()))
    sets = distinct.sets(rolled, numbers, **_cell()).unionByName(distinct.sets(raw, numbers, **_cell()))
    return distinct.measured(cells, sets, distinct.unnumbered(raw, numbers, provider_key="provider_key"), provider_key="provider_key")
