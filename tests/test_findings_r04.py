"""Rows of round 4's findings against the same SQL, over small tables with what the given ones lack."""

from time import perf_counter

import duckdb
import pytest
from compare import canonical
from conftest import SF
from pyspark.sql import functions as F

import meterlake.inventory_queries
import meterlake.reading_queries
import meterlake.state_queries
from meterlake.functions import exprs as X
from meterlake.queries import ORACLES, QUERIES


def agree(spark, folder, name, **tables):
    """The query and its SQL over tables given as SQL; the rows."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cur = con.execute(ORACLES[name])
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    df = QUERIES[name](spark, str(folder))
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got == want
    return got[1]


@pytest.mark.parametrize("n", [0, 3, 200])
def test_scores_round_halves_to_even(spark, tmp_path, n):
    agree(spark, tmp_path, "agg33_organisation_scores", customer=f"SELECT i AS c_custkey, i - 20.5::DOUBLE AS c_acctbal FROM range({n}) r(i)")


def test_turns_of_tools_with_blanks_and_nulls(spark, tmp_path):
    """Ends of lines at the end of a name, spaces other than U+0020, no text, no number, numbers below zero."""
    texts = "[NULL, '', 'abc' || chr(10), 'a' || chr(9) || ' x', 'ab' || chr(160) || chr(12288), chr(10) || '  ', '<b>x', '   ', 'ab  cd', chr(8195) || 'a' || chr(13)]"
    rows = f"SELECT s AS conv_id, t AS turn, 'user' AS role, {texts}[s + 1] AS text FROM range(10) a(s), (SELECT unnest([NULL, -6, -5, -4, -1, 0, 1, 2, 3, 4, 5, 11])::BIGINT AS t)"
    assert len(agree(spark, tmp_path, "fn_meta_turns", conversations=rows)) == 120


def test_scores_of_many_lines(spark, tmp_path):
    """8,000 lines of one supplier, before quadratic work; suppliers, values and taxes of null."""
    lines = "SELECT CASE WHEN i < 8000 THEN 1 WHEN i % 40 <> 0 THEN i % 40 END AS l_suppkey, CASE WHEN i % 40 <> 7 AND i % 11 <> 0 THEN (hash(i) % 1000) / 100.0::DOUBLE END AS l_discount, CASE WHEN i % 40 <> 8 THEN (i * 7 % 300) / 100.0::DOUBLE END AS l_tax FROM range(9000) r(i)"
    began = perf_counter()
    assert len(agree(spark, tmp_path, "alg11_baseline_scores", lineitem=lines)) == 40
    values = F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda x: (x * 7919 % 8009).cast("double"))
    assert spark.range(2).select(X.baseline_score(F.lit(5000.0) + F.col("id"), values).alias("s")).collect() == [(55,), (55,)]
    assert perf_counter() - began < 30


def many_sessions(spark, folder, name):
    """66,000 events of 33,000 users; a group of Python's own for each session or island took over a minute."""
    events = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(i * 7919 % 9000 + i // 33000 * 6000) AS ts, i % 33000 AS user_id, 'click' AS event_type, 1.5::DOUBLE AS value, '{\"k\": 3}' AS props FROM range(66000) r(i)"
    began = perf_counter()
    rows = agree(spark, folder, name, events=events)
    assert perf_counter() - began < 60
    return rows


def test_turns_of_many_islands(spark, tmp_path):
    assert len(many_sessions(spark, tmp_path, "jn8_turn_usage_match")) > 25_000


def test_turns_of_many_sessions(spark, tmp_path):
    assert len(many_sessions(spark, tmp_path, "alg29_turn_matches")) > 60_000


def test_plan_of_session_files_is_small(spark, capsys):
    """What is used often is in the plan once; the driver ran out of 750 MB of heap over it."""
    QUERIES["src14_session_files"](spark, SF).explain(True)
    assert len(capsys.readouterr().out) < 500_000
