"""Nearest neighbours against all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import nearest
from meterlake.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain(rows, k):
    """rows: (id, vector or None, asks)."""
    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = [(i, np.array(v, float), asks) for i, v, asks in rows if good(v)]
    out = []
    for n, (i, v, asks) in enumerate(rows):
        if asks:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), (j is None, j or 0)) for m, (j, w, _) in enumerate(rows) if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, None if j[0] else j[1], d) for r, (d, j) in enumerate(near)]
    return sorted(out, key=repr)


def same(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12, abs_tol=1e-300) for a, b in zip(got, want))


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_all_pairs(spark, monkeypatch, small, kind):
    """Random vectors, a crowd within the rounding error of each other, many copies of one, lengths that differ, bad ones."""
    if small:
        for name, value in (("QUERIES", 9), ("CANDIDATES", 50), ("LEAST", 5), ("TILE", 3)):
            monkeypatch.setattr(nearest, name, value)
    rng = random.Random(13)
    f = (lambda x: float(np.float32(x))) if kind == "float" else float
    vector = lambda n=8: [f(rng.gauss(0, 1)) for _ in range(n)]
    centre, hot = vector(), vector()
    vectors = [vector() for _ in range(60)] + [[f(x + rng.gauss(0, 1e-4)) for x in centre] for _ in range(60)] + [list(hot)] * 60
    vectors += [vector(3) for _ in range(4)] + [vector(5)] + [[0.0, -0.0] + hot[2:], [-0.0, 0.0] + hot[2:]]
    vectors += [None, [], [0.0] * 8, [float("nan")] + hot[1:], [float("inf")] + hot[1:], [f(1e-38)] * 8, [f(3e38 if kind == "float" else 1e200)] * 8]
    if kind == "double":
        vectors += [[5e-324] * 8, [1e-320] * 8]
    ids = list(range(len(vectors)))
    rng.shuffle(ids)
    rows = [(i, v, i % 5 == 0) for i, v in zip(ids, vectors)] + [(None, vector(), False), (None, vector(), True), (ids[3], vectors[3], True), (ids[3], vectors[4], True)]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(400, [1.0, None] + hot[2:], True, 1)], f"`row.id` long, size array<{kind}>, block boolean, kind int")
    for k in (1, 4, 300):
        got = sorted((tuple(r) for r in nearest.nearest(df, F.col("block"), k, "row.id", "size").collect()), key=repr)
        same(got, plain(rows, k))


def test_empty_and_alone(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest.nearest(df, F.col("vec_id") == 100).count() == 0
    assert nearest.nearest(df.limit(0), F.col("vec_id") == 100).count() == 0
    assert nearest.nearest(df.union(df), F.lit(None).cast("boolean")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for scale in (1e-3, 1, 1e6):
        x, y = rng.normal(0, scale, (40, 64)).astype(np.float32), rng.normal(0, 1, (50, 64)).astype(np.float32)
        least, most = nearest.Rounded(x).bounds(slice(0, 40), nearest.Rounded(y))
        exact = np.sqrt(((x[:, None].astype(float) - y[None].astype(float)) ** 2).sum(axis=2))
        assert (least <= exact).all() and (exact <= most).all() and (most - least < 0.2 * scale + 0.2).all()


def test_query(spark):
    rows = [(i, v, i % 100 == 0) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()]
    got = sorted((tuple(r) for r in Q.op13_block_neighbours(spark, SF).collect()), key=repr)
    same(got, plain(rows, 10))
    assert got
