"""Buckets as state: exactly once over batches and restarts, and late events open them again."""

import time
from datetime import datetime

import pytest
from test_sources import wire

from meterlake.streaming import buckets as B
from meterlake.streaming import usage as stream


@pytest.fixture
def four_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_late_events_once_over_a_restart(spark, tmp_path, four_partitions):
    source = tmp_path / "in"
    source.mkdir()
    table = str(tmp_path / "buckets")

    def run(name, *lines, versions):
        (source / name).write_text("\n".join(lines))
        q = B.bucket_sink(B.compacted(stream.wire_stream(spark, str(source)), delay=1), table, str(tmp_path / "state"), "0 seconds")
        try:
            for _ in range(240):  # until the timers have gone off
                time.sleep(0.25)
                assert q.exception() is None
                try:
                    if spark.read.parquet(table).count() >= versions:
                        break
                except Exception:  # not written yet
                    pass
        finally:
            q.stop()
        return {(r.bucket.replace(tzinfo=None), r.providerKey): (r.events, r.input_tokens, r.version) for r in B.buckets(spark, table).collect()}

    at = lambda d, h, m: datetime(2024, 1, d, h, m)
    got = run("1.json", wire("a", ts="2024-01-02T12:01:00Z"), wire("a", ts="2024-01-02T12:01:00Z"), wire("b", ts="2024-01-02T12:20:00Z", inputTokens=7), wire("c", ts="2024-01-02T12:02:00Z", providerKey="q"), versions=3)
    assert got == {(at(2, 12, 0), "p"): (1, 5, 1), (at(2, 12, 15), "p"): (1, 7, 1), (at(2, 12, 0), "q"): (1, 5, 1)}
    # A new query on the same state: a key said again changes nothing, one a day late opens a bucket of its own, one more reopens another.
    got = run("2.json", wire("a", ts="2024-01-02T12:01:00Z"), wire("late", ts="2024-01-01T12:00:00Z"), wire("d", ts="2024-01-02T12:29:00Z"), versions=5)
    assert got == {(at(2, 12, 0), "p"): (1, 5, 1), (at(2, 12, 15), "p"): (2, 12, 2), (at(2, 12, 0), "q"): (1, 5, 1), (at(1, 12, 0), "p"): (1, 5, 1)}
