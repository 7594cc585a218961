"""Top-k at the ends: components beyond a long, clashing names, several groups of tiles."""

import math

import numpy as np
from pyspark.sql import functions as F

from relspark.llm import topk


def brute(rows, queries, k, scale=256):
    whole = lambda x: math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale
    rows = [(i, [whole(float(x)) for x in v]) for i, v in rows]
    out = set()
    for q, x in rows:
        if q in queries:
            scores = [(-min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1), i) for i, y in rows if i != q and len(y) == len(x)]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def test_components_beyond_a_long(spark):
    for big in (2.0**20, 2.0**24, 2.0**27, 2.0**45, 1e30, 1.7e308):
        rows = [(0, [big, 1.0, -0.3]), (1, [big, -big, 0.7]), (2, [-big, 3.0, 2.0]), (3, [1.0, big, big]), (4, [0.001, 0.002, -0.003]), (5, [big, -big, 0.7])]
        d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {tuple(r) for r in topk.top_k(d, d.filter("vec_id < 3"), 4).collect()}
        assert got == brute(rows, {0, 1, 2}, 4)


def test_many_tiles_and_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_QUERIES", 7)
    monkeypatch.setattr(topk, "TILE_ROWS", 11)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4 + i % 2).astype(float).tolist()) for i in range(400)]
    d = spark.createDataFrame([(*r, 0, "x", b"y") for r in rows], "vec_id long, embedding array<double>, rank int, score string, tile binary").repartition(6)
    got = [tuple(r) for r in topk.top_k(d, d.filter("vec_id % 5 = 0"), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, set(range(0, 400, 5)), 5)
    assert topk.top_k(d, d.limit(0)).count() == 0


def test_candidates_are_never_broadcast(spark):
    d = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    plan = topk.top_k(d, d.filter("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
