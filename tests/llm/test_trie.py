"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from meterlake.llm import queries as Q
from meterlake.llm import trie

SF = "/root/testdata/sf0.001"


def plain(convs):
    """convs: id -> list of (role, text).  The rows of the trie."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    ends = {k: ",".join(str(c) for c in sorted(m) if tuple(convs[c]) == k) for k, m in members.items()}
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()}


def turns_of(rows):
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    out = defaultdict(list)
    for r in sorted(rows, key=key):
        if r[0] is not None:
            out[r[0]].append((r[2] or "", r[3] or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("cell", [1, 12])
def test_shapes(spark, monkeypatch, cell):
    """Bushy tries, one long chain with a branch at every turn, one conversation many times; ties, nulls, repeated rows."""
    monkeypatch.setattr(trie, "CELL_BITS", cell)
    monkeypatch.setattr(trie, "IDS_BITS", 2)
    rng, rows = random.Random(5), []
    for c in range(120):
        for _ in range(rng.randrange(1, 6)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "bé😀"])))
    for c in range(200, 230):  # each leaves the chain a turn later
        rows += [(c, t, "user", f"chain {t}" if t < c - 200 else f"own {c}") for t in range(c - 198)]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(4)]
    rows += [(c, 1, "user", "alone") for c in range(1001, 1013)]  # the first of their group is absent
    rows += [(5_000_000_000, 1, "user", "far id"), (None, 1, "user", "no id")] + rows[:7]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, depth long, run string, p1 string, `n.dot` int")
    got = trie.conversation_trie(df, "id", "depth", "run", "p1")
    assert {tuple(r) for r in got.collect()} == plain(turns_of(rows)) and got.count() == len(plain(turns_of(rows)))
    again = trie.conversation_trie(df, "id", "depth", "run", "p1", rebuild=trie.spliced)
    assert {tuple(r) for r in again.collect()} == plain(rebuilt(turns_of(rows)))
    assert any(not x for x in rebuilt(turns_of(rows)).values())  # without a turn


def test_empty_table(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert {tuple(r) for r in Q.op12_peeled_trie(spark, SF).collect()} == plain(rebuilt(turns_of(rows)))
