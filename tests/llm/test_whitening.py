from __future__ import annotations

import math

import numpy as np
import pytest

from cadenza.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def held_to(rows, got, most=16):
    """rows: (id, vector) that take part; got: rows of whiten. Plain numpy on the different vectors."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = (n * fit - np.array(sums)) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, len(values), int((values > 1e-9 * values[0]).sum()))
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == set(x) and all(sorted(c) == list(range(1, k + 1)) for c in by_id.values())
    signs = {}
    for i, v_ in x.items():
        want = (np.array(v_) * n - np.array(sums)) / n @ vectors[:, :k] / np.sqrt(values[:k])
        for c, r in by_id[i].items():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v_, sums, strict=True))
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-10)
            assert r.identity_error < 1e-8
            if abs(want[c - 1]) > 1e-6:
                signs.setdefault(c, np.sign(r.whitened * want[c - 1]))
            assert r.whitened * signs.get(c, 1) == pytest.approx(want[c - 1], abs=1e-7)


def test_given_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    held_to([(r.vec_id, r.embedding) for r in rows.collect()], whitening.op13_whiten(spark, sf_dir).collect())


def test_repeated_unusable_and_few_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=5) * [9, 7, 5, 3, 1]).tolist()) for i in range(60)]
    good += [(i, good[0][1]) for i in range(60, 100)]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("-inf")] * 5), (205, [1.0, 2.0]), (206, [1e300] * 5)]
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in good + bad], SCHEMA + ", n int, x string, component double")
    got = whitening.whiten(df).collect()
    held_to(good, got)
    assert len(got) == 500
    again = whitening.whiten(spark.createDataFrame([*good, (None, good[0][1]), (1, good[1][1])], SCHEMA)).collect()
    assert len(again) == 510 and sum(r.vec_id is None for r in again) == 5
    assert whitening.whiten(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)
    assert whitening.whiten(same).collect() == []


def test_fewer_vectors_than_dimensions(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(6)]
    held_to(rows, whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e9 * i, -3e8 * i * i, 5.0]) for i in range(8)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for g in got:
        want = sum((8 * a - s) ** 2 for a, s in zip(x[g.vec_id], sums, strict=True))
        assert g.deviation == (want if want < 1 << 63 else None)


def plain_inertia(v, s):
    return int((np.linalg.eigvalsh(v) < s).sum())


@pytest.mark.parametrize("seed", range(20))
def test_counts_are_those_of_all_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 24))
    a = rng.normal(size=(d, d)) * (rng.random((d, d)) < rng.choice([0.2, 1.0]))
    v = a + a.T
    for s in [*rng.normal(size=6) * 3, 0.123]:
        assert whitening.inertia_below(v, s) == plain_inertia(v, s)
    zero_diagonal = v - np.diag(np.diag(v))
    assert whitening.inertia_below(zero_diagonal, 1e-3) == plain_inertia(zero_diagonal, 1e-3)


@pytest.mark.parametrize("spectrum", [[9, 8, 7, 6, 5], [5, 5, 5, 1, 1, 0.5], [3, 3 + 1e-9, 3 - 1e-9, 2, 1], [1e12, 1, 1e-3, 1e-3], [4, 2, 0, 0, 0], [7], [1] * 12, [10, *[1 + i * 1e-13 for i in range(6)]]])
def test_leading_values_and_vectors(spectrum):
    rng = np.random.default_rng(len(spectrum))
    q = np.linalg.qr(rng.normal(size=(len(spectrum), len(spectrum))))[0]
    v = q @ np.diag(spectrum) @ q.T
    values, vectors = whitening.leading(v, 4)
    want = sorted((s for s in spectrum if s > 1e-13 * max(spectrum)), reverse=True)[:4]
    assert values == pytest.approx(want, rel=1e-8, abs=1e-12 * max(spectrum))
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(vectors @ v - values[:, None] * vectors).max() < 1e-11 * max(spectrum)


def test_many_dimensions():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(400, 200)) * np.linspace(1, 3, 200)
    v = np.cov(a.T)
    values, vectors = whitening.leading(v, 16)
    assert values == pytest.approx(np.linalg.eigvalsh(v)[::-1][:16], rel=1e-12)
    assert np.abs(vectors @ v - values[:, None] * vectors).max() < 1e-10
