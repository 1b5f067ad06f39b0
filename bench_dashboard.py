"""The dashboard's scenarios over a year, asked of a store of a million events, from raw events and from the store's rollups.

One line of JSON: p50 and p95 in milliseconds of each scenario.  BENCH_EVENTS, BENCH_RUNS and BENCH_CPUS choose the size.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from datetime import UTC, datetime, timedelta

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DAYS, USERS, PROVIDERS, MODELS, TEAMS = 400, 100, 5, 10, 4
ZONES = ("Asia/Seoul", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "UTC")
NOW = datetime(2024, 6, 1, tzinfo=UTC)


def fixture(spark, events: int):
    """Events spread evenly over the days before NOW, all else by remainders."""
    from pyspark.sql import functions as F

    i, a_day = F.col("id"), events // DAYS
    at = F.lit(NOW - timedelta(days=DAYS)) + F.make_dt_interval(days=(i / a_day).cast("int"), secs=(i % a_day) * F.lit(86_400 // a_day))
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    return spark.range(events // DAYS * DAYS).select(
        i.alias("event_id"), F.sha2(i.cast("string"), 256).alias("dedup_key"), text("p", i % PROVIDERS).alias("provider_key"), (i % USERS).alias("user_id"),
        text("s", F.floor(i / 20)).alias("session_id"), text("m", i % MODELS).alias("model"), text("h", i % 7).alias("host"), at.alias("ts"),
        (i % 900 + 100).alias("input_tokens"), (i % 300).alias("output_tokens"), (i % 500).alias("cache_read_tokens"), (i % 70).alias("cache_creation_tokens"),
        (i % 1000 / 10_000).cast("decimal(18,8)").alias("cost_usd"), F.when(i % 50 == 0, "unpriced").otherwise("priced").alias("cost_status"), F.lit(1).cast("long").alias("event_count"), (i % USERS % TEAMS).alias("team_id"), F.lit(None).cast("int").alias("revision_id"),
    )


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from meterlake.functions import exprs as X
    from meterlake.operators.usage import Scope
    from meterlake.plans import jobs
    from meterlake.plans.maintenance import Maintenance
    from meterlake.store import UsageStore

    cpus, events, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_EVENTS", "1000000")), int(os.environ.get("BENCH_RUNS", "20"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="spark-dashboard-")
    e = fixture(spark, events)
    users = e.select("user_id").distinct().withColumn("label", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    store = UsageStore(spark, root, spark.createDataFrame([], "id int"), spark.createDataFrame([], "user_id long"), users, users.withColumnRenamed("user_id", "team_id"))
    e.withColumn("event_month", X.utc_month(F.col("ts"))).repartition("event_month").write.partitionBy("event_month").parquet(f"{root}/usage_events")
    store._segments(dirty=store._marks(store.events()))
    begun = NOW - timedelta(days=DAYS)
    store.compact(str(begun.replace(tzinfo=None)), str(NOW.replace(tzinfo=None)))
    loop = Maintenance(store, begun, 16, ZONES)
    loop.watermark, loop.cutover = NOW, jobs.Cutover("active", 3600, 0, NOW, NOW)
    loop.zones(NOW, [])
    year = Scope(str((NOW - timedelta(days=365)).replace(tzinfo=None)), str(NOW.replace(tzinfo=None)))
    scopes = {f"overview {z}": (z, {}) for z in ZONES} | {"provider": ("UTC", {"provider": "p1"}), "team": ("UTC", {"team": 2}), "individual": ("UTC", {"user": 7})}

    out, answers = {}, {}
    for source, layers in (("raw", None), ("rolled up", loop)):
        store.layers = layers
        for name, (zone, more) in scopes.items():
            times = []
            for _ in range(runs + 2):
                began = time.perf_counter()
                rows = store.daily_series(Scope(year.start, year.end, **more), zone=zone).collect()
                times.append(1000 * (time.perf_counter() - began))
            rows = sorted(tuple(r[c] for c in sorted(r.asDict())) for r in rows)
            assert 360 <= len(rows) <= 367 and answers.setdefault(name, rows) == rows, (name, len(rows))
            times = sorted(times[2:])
            out[f"{source}: {name}"] = [round(times[(len(times) - 1) // 2]), round(times[-(-len(times) * 95 // 100) - 1])]
    spark.stop()
    print(json.dumps({"metric": "p50 and p95 of the dashboard's scenarios", "unit": "ms", "events": events, "runs": runs, "scenarios": out}))


if __name__ == "__main__":
    main()
