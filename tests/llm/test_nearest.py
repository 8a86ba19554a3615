from __future__ import annotations

import numpy as np
import pytest

from cadenza.llm import nearest


def brute(vectors, query, k):
    found = []
    for i, v in vectors:
        if i != query[0]:
            a, b = np.array(v, float), np.array(query[1], float)
            found.append((-float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i))
    return sorted(found)[:k]


def test_recall_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in rows.collect()]
    got = {}
    for r in nearest.op4_nearest(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits, total = 0, 0
    for q in [v for v in vectors if v[0] % 50 == 0]:
        want = brute(vectors, q, 5)
        assert sorted(got[q[0]]) == [1, 2, 3, 4, 5]
        hits += len({i for _, i in want} & {i for i, _ in got[q[0]].values()})
        total += 5
        by_id = dict(vectors)
        for i, s in got[q[0]].values():
            a, b = np.array(by_id[i], float), np.array(q[1], float)
            assert s == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)
    assert hits / total > 0.95


def test_clustered_vectors_and_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CLASS_BLOCK", 300)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 32)) * 3
    x = [(i, (centres[i % 8] + rng.normal(size=32)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in nearest.nearest(df, df.where("vec_id % 50 = 0")).collect()}
    want = {(q[0], i) for q in x if q[0] % 50 == 0 for _, i in brute(x, q, 5)}
    assert len(got & want) / len(want) > 0.95


def test_unusable_equal_and_few_vectors(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(0, same), (50, [2.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 1.0]), (4, [float("nan"), 1.0, 1.0]), (5, [1.0, 1.0]), (None, same), *[(i, same) for i in range(10, 20)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 10), (0, 11), (0, 12), (0, 13), (0, 14), (50, 0), (50, 10), (50, 11), (50, 12), (50, 13)]
    few = df.where("vec_id IN (0, 50)")
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(few, few).orderBy("query_id").collect()] == [(0, 1, 50), (50, 1, 0)]
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_estimates_keep_to_their_bounds():
    rng = np.random.default_rng(8)
    x, q = nearest.unit(rng.normal(size=(3000, 64))), nearest.unit(rng.normal(size=(20, 64)))
    centre, turn = x.mean(axis=0), nearest.rotation(64)
    near, error = nearest.estimates(*nearest.encode(x, centre, turn), q, centre, turn)
    assert np.mean(np.abs(near - q @ x.T) <= error) > 0.97


def test_queries_go_by_the_length_of_the_table(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(1, 9)] + [(50, [1.0, 3.1, 2.0])] + [(k, [1.0, 2.0]) for k in (100, 150, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, df.where("vec_id % 50 = 0"), nearest=1).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(50, 3)]


def test_vectors_of_any_size_neither_overflow_nor_vanish(spark):
    rng = np.random.default_rng(4)
    x = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 24)), start=1)]
    odd = [(2000, (rng.normal(size=24) * 1e-170).tolist()), (2050, (rng.normal(size=24) * 1e200).tolist()), (2001, [5e-324] + [0.0] * 23), (2002, [1.7e308] * 24)]
    df = spark.createDataFrame(x + odd, "vec_id long, embedding array<double>")
    brought = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in x + odd]
    rows = nearest.nearest(df, df.where("vec_id % 50 = 0")).collect()
    want = {(q[0], i): -s for q in brought if q[0] % 50 == 0 for s, i in brute(brought, q, 5)}
    assert {q for q, _ in want} >= {2000, 2050}
    assert len({(r.query_id, r.vec_id) for r in rows} & set(want)) / len(want) == 1.0
    assert all(r.score == pytest.approx(want[r.query_id, r.vec_id], abs=1e-12) for r in rows)


def test_floats_clashing_columns_and_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    monkeypatch.setattr(nearest, "_LEAST_BLOCK", 100)
    rng = np.random.default_rng(6)
    x = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame([(*r, 1, 2.0, "c") for r in x], "vec_id long, embedding array<float>, q int, v double, code string")
    rows = nearest.nearest(df, df.where("vec_id % 50 = 0")).collect()
    want = {(q[0], i) for q in x if q[0] % 50 == 0 for _, i in brute(x, q, 5)}
    assert len(rows) == 90 and len({(r.query_id, r.vec_id) for r in rows} & want) / len(want) > 0.95
