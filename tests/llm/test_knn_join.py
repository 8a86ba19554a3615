from __future__ import annotations

import math

import numpy as np
import pytest

from cadenza.llm import knn_join

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5):
    """Plain whole numbers of Python, so nothing rounds or overflows."""
    held = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    out = {}
    for n, (i, q) in enumerate(held):
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for m, (j, x) in enumerate(held) if m != n and j != i)[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return out


def searched(df, **how):
    out = {}
    for r in knn_join.top_products(df, df.where("vec_id % 50 = 0"), **how).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_clusters_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "ROWS_A_CELL", 20)
    monkeypatch.setattr(knn_join, "QUERY_GROUP", 3)
    monkeypatch.setattr(knn_join, "ROW_BLOCK", 90)
    monkeypatch.setattr(knn_join, "_LEAST_BLOCK", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=12) * 0.1).tolist()) for i in range(1200)]
    assert searched(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_only_needed_rows_are_sent(spark):
    """Two far clusters whose queries need nothing of the other one."""
    rng = np.random.default_rng(5)
    centres = np.zeros((2, 8))
    centres[0, 0], centres[1, 1] = 100, 100
    pivots = knn_join.whole(centres)
    x = knn_join.whole(centres[np.arange(400) % 2] + rng.normal(size=(400, 8)) * 0.01)
    cell, r = knn_join.nearest_pivots(x, pivots)
    assert (cell == np.arange(400) % 2).all()
    q = x[0]
    known = np.sort(pivots @ q)[-1]
    reach = pivots[cell] @ q + np.linalg.norm(q) * r
    assert (reach >= x @ q).all()
    assert (reach[cell == 1] < known).all() and (reach[cell == 0] >= x[cell == 0] @ q).all()


def test_hot_vectors_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "_LEAST_BLOCK", 50)
    monkeypatch.setattr(knn_join, "ROW_BLOCK", 50)
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(400)] + [(i, [float(i % 7), -1.5, 0.25]) for i in range(400, 600)] + [(700, [0.0, 0.0, 0.0]), (7, [9.0, 9.0, 9.0])]
    assert searched(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    again = searched(spark.createDataFrame([*rows, (50, [9.0, 9.0, 9.0]), (50, same)], SCHEMA))  # a query's id, repeated
    assert again[50] == brute(rows)[50] and again[0][0][1:] == (7, brute(rows)[0][0][2]) and again[0][1][1] == 50


def test_unusable_few_and_large_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [3e5, -2e5]), (50, [1e6, 1e6]), (1, [-1e6, 1e6]), (2, [0.001, 0.002]), (100, [-0.001, 0.0])]
    bad = [(150, None), (200, []), (250, [1.0, None]), (300, [nan, 1.0]), (350, [inf, 1.0]), (400, [1.0, 2.0, 3.0]), (450, [1e300, 0.0]), (500, [2e7, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in good + bad], SCHEMA + ", r double, v string")
    assert searched(df) == brute(good)
    assert searched(df.limit(0)) == {}
    one = spark.createDataFrame([(50, [1.0])], SCHEMA)
    assert searched(one) == {}


def test_products_beyond_doubles(spark):
    """Scores of up to 2^62, which doubles would round."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) * 2e6).tolist()) for i in range(300)]
    got = searched(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert max(s for v in got.values() for _, _, s in v) > 1 << 53


@pytest.mark.parametrize("most", [10, 1000])
def test_cells_are_dealt_whole(most):
    sizes = np.array([5, 3, 0, 40, 7, 1])
    first, many, parts = knn_join.dealt(sizes, np.array([0, 1, 2, 4, 3, 5]), most)
    held = np.zeros(parts + 1)
    for c, n in enumerate(sizes):
        for p in range(many[c]):
            held[first[c] + p] += n / many[c]
    assert held.sum() == sizes.sum() and held.max() <= max(most, 10)
