from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cadenza.llm import quality
from cadenza.llm.textbytes import column_bytes
from tests.llm.helpers import documents, empty, odd


def test_held_out_grades_are_told_apart(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = documents(spark, sf_dir)
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", quality.grade().alias("grade"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.learn(docs, ratings.where(~held))
    rows = quality.rate(docs, model).join(ratings.where(held), "doc_id").collect()
    kept = lambda g: np.mean([r.kept for r in rows if r.grade == g])
    assert kept(2) > 0.93 and kept(1) < 0.15 and kept(0) < 0.1
    means = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert (np.diff(model.thresholds) > 0).all()


def test_odd_rows_and_no_ratings(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", quality.grade().alias("grade")))
    rows = quality.rate(odd(spark), model).collect()
    assert len(rows) == 11
    assert not any(r.kept for r in rows if r.doc_id in (2, 3, 4))
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert all(r.toxic_probability is None and r.tail_probability == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert all(0 <= r.toxic_probability <= 1 for r in rows if r.doc_id not in (2, 3, 4))
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert quality.learn(docs, none) is None
    assert quality.rate(odd(spark), None).where("kept OR expected_grade > 0").count() == 0
    assert quality.rate(odd(spark), None).where("toxic_probability IS NOT NULL").count() == 0
    assert quality.rate(empty(spark), model).count() == 0


def test_features_do_not_hang_on_neighbours():
    texts = ["One two!! THREE", "", "  x", "One two!! THREE"]
    tokens, extra = quality.features(*column_bytes(pa.array(texts)))
    alone, alone_extra = quality.features(*column_bytes(pa.array(texts[:1])))
    assert (tokens[0] == alone[0]).all() and (tokens[3] == alone[0]).all() and (extra[0] == alone_extra[0]).all()
    assert len(tokens[1]) == 0 and len(tokens[2]) == 1


def test_probabilities_and_the_fit_are_those_of_plain_formulas():
    """Each row's probabilities by the cumulative-link formula, one by one, and a fit that no small step betters."""
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), rng.normal(size=5), np.array([-0.4, 1.1]))
    tokens, extra = quality.features(*column_bytes(pa.array(["one two 3", "", "Three four, FIVE"])))
    got = model.at_least(model.score(tokens, extra))
    for i in range(3):
        s = sum(float(model.weights[t]) for t in tokens[i]) + sum(a * b for a, b in zip(extra[i], model.extra, strict=True))
        assert np.allclose(got[i], [1 / (1 + np.exp(-(s - t))) for t in (-0.4, 1.1)], atol=1e-6)
    grades = np.arange(300) % 3
    said = [np.array([g, 10 + (i % 5)]) for i, g in enumerate(grades)]
    fitted = quality.fit(said, np.zeros((300, 5)), grades)

    def loss(w, t):
        out = 0.0
        for words, g in zip(said, grades, strict=True):
            above = [1.0, *(1 / (1 + np.exp(-(w[words].sum() - x))) for x in t), 0.0]
            out -= np.log(max(above[g] - above[g + 1], 1e-9))
        return out / 300

    best = loss(fitted.weights.astype(float), fitted.thresholds)
    assert best < 0.3 * np.log(3) and fitted.thresholds[0] < fitted.thresholds[1]
    for token, sign in ((0, 1), (2, -1)):
        worse = fitted.weights.astype(float).copy()
        worse[token] += sign * 2.0
        assert loss(worse, fitted.thresholds) > best
