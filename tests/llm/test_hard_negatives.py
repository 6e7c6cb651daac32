"""Hard negatives against brute force: ties, hot vectors, odd rows, many groups and chunks; the walk stops where it is certified."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ledgerflow.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, cluster int, score string, anchor int"


def brute(rows, is_anchor, relabel=False):
    used = []
    for i, e, y in rows:
        if i is None or e is None or y is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        used.append((i, [math.floor(256 * float(np.float32(x))) for x in e], (y + 1) % 10 if relabel and i % 7 == 0 else y))
    out = []
    for i, e, y in {(i, tuple(e), y) for i, e, y in used if is_anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), j, z) for j, f, z in used if j != i)
        positive = [(-s, j) for s, j, z in scored if z == y][:5]
        for p, j in positive:
            hard = [(-s, k) for s, k, z in scored if z != y and 80 * p <= -100 * s <= 100 * p][:5]
            out += [(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(hard)]
    return sorted(out)


def result(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA)


def rows_of(n, dim=16, hot=0):
    rnd = np.random.default_rng(n)
    centers = rnd.normal(size=(12, dim))
    x = centers[rnd.integers(0, 12, n)] + rnd.normal(scale=0.4, size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if hot:
        x[:hot] = x[0]
    return [(i, [float(v) for v in x[i]], int(rnd.integers(0, 4))) for i in range(n)]


def test_against_brute_force(spark):
    rows = rows_of(900, hot=300)
    odd = [(900, None, 1), (1000, [0.1] * 16, None), (None, [0.1] * 16, 1), (1100, [float("nan")] * 16, 1), (1200, [float("inf")] + [0.0] * 15, 1), (1300, [None] + [0.1] * 15, 1)]
    odd += [(1400, [0.0] * 16, 1), (1500, [], 2), (1600, [0.5] * 4, 3), (1700, [9000.0] * 16, 0), (1800, [-0.2] * 16, 1), (60, rows[60][1], rows[60][2]), (7, rows[7][1], rows[7][2])]
    want = brute(rows + odd, lambda i: i % 20 == 0)
    for group, chunk in ((8192, 16_384), (16, 100)):
        got = hard_negatives.mine(table(spark, rows + odd), F.col("vec_id") % 20 == 0, group=group, chunk=chunk)
        assert result(got) == want
    assert len(want) > 500


def test_query(spark, tmp_path):
    rows = rows_of(1200)
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert result(queries.op13_hard_negatives(spark, str(tmp_path))) == brute(rows, lambda i: i % 100 == 0, relabel=True)


def test_empty_tables(spark):
    assert hard_negatives.mine(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(table(spark, rows_of(50)), F.col("vec_id") < 0).count() == 0
    assert hard_negatives.mine(table(spark, [(0, [1.0, 2.0], 1)]), F.col("vec_id") == 0).count() == 0


def test_walk_stops_early_and_bounds_hold():
    rnd = np.random.default_rng(5)
    near = np.floor(256 * (np.eye(32)[0] + rnd.normal(scale=0.02, size=(2000, 32)))).astype(np.int64)
    far = np.floor(256 * rnd.normal(size=(40_000, 32)) / 6).astype(np.int64)
    candidates, anchors = np.concatenate([far, near]), near[:20]
    center = anchors.sum(0) / np.linalg.norm(anchors.sum(0))
    order, bound = hard_negatives.shared_list(center, anchors, candidates)
    scores = anchors @ candidates[order].T
    assert (scores <= np.linalg.norm(anchors, axis=1)[:, None] * bound[None, :] + 1e-6 * np.abs(scores).max()).all()
    seen = []
    allowed = lambda r, c: (seen.append(len(c)), np.ones(len(c), bool))[1]
    t, s, _ = hard_negatives.walk(center, anchors, candidates, np.arange(len(candidates)), np.arange(20), np.full(20, -(2**63)), np.full(20, 2**63 - 1), allowed, 5)
    assert len(seen) < len(candidates) / hard_negatives.STEP / 4  # most of the list is never scored
    assert s.reshape(20, 5).tolist() == np.sort(anchors @ candidates.T, axis=1)[:, :-6:-1].tolist() and t.tolist() == np.repeat(np.arange(20), 5).tolist()
