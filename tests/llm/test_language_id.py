from __future__ import annotations

import numpy as np

from cadenza.llm import language_id
from tests.llm.helpers import documents, empty, odd


def test_held_out_languages_are_found(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = documents(spark, sf_dir)
    rows = language_id.op7_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, sf_dir):
    model = language_id.learn(documents(spark, sf_dir))
    got = {(r.doc_id, r.lang_pred == "und") for r in language_id.predict(odd(spark), model, ["doc_id", "target"]).collect()}
    assert {(2, True), (3, True), (4, True), (6, True), (1, False), (8, False)} <= got
    kept = language_id.keep_identified(odd(spark), model)
    assert kept.columns == odd(spark).columns
    assert not {2, 3, 4, 6} & {r.doc_id for r in kept.collect()}


def test_nothing_or_one_language_to_learn_from(spark):
    assert language_id.predict(odd(spark), language_id.learn(empty(spark)), ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    one = spark.createDataFrame([(i, "some words here", "en", "a", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    row = language_id.predict(one.limit(1), language_id.learn(one), ["doc_id"]).first()
    assert (row.lang_pred, row.score) == ("en", 1.0)


def test_counts_do_not_hang_on_steps(monkeypatch):
    data = np.random.default_rng(2).integers(32, 250, 5000).astype(np.uint8)
    whole = language_id.trigram_counts(data)
    monkeypatch.setattr(language_id, "_STEP", 97)
    assert (language_id.trigram_counts(data) == whole).all()


def test_codewords_lie_apart():
    for n in (2, 4, 9, 40):
        code = language_id.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 3
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_decoding_is_that_of_the_plain_formula():
    """Losses, shares and the nearest word by loops over words and bits."""
    rng = np.random.default_rng(9)
    code = language_id.codewords(5)
    model = language_id.Model(tuple("abcde"), code, rng.normal(size=(language_id.DIMENSIONS, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]).astype(np.float32), rng.random(code.shape[1]) + 0.5)
    x = language_id.features(rng.integers(0, 4, (6, language_id.DIMENSIONS)))
    best, score, second = model.decode(x)
    for i in range(6):
        margin = [sum(float(a) * float(b) for a, b in zip(x[i], model.weights[:, j], strict=True)) + model.bias[j] for j in range(code.shape[1])]
        loss = [sum(model.trust[j] * np.log1p(np.exp(-margin[j] * word[j])) for j in range(code.shape[1])) for word in code]
        share = sorted((np.exp(min(loss) - v) for v in loss), reverse=True)
        assert best[i] == int(np.argmin(loss))
        assert np.allclose([score[i], second[i]], [share[0] / sum(share), share[1] / sum(share)], atol=1e-4)


def test_many_languages_are_bounded_and_reruns_agree(spark):
    rows = [(i, f"wort {i % 700} und mehr davon {i % 7}", f"l{i % 700:03}") for i in range(3000)] + [(10_000 + i, f"some words {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first, again = language_id.learn(docs, max_rows=600), language_id.learn(docs.repartition(7), max_rows=600)
    assert len(first.languages) == language_id.MAX_LANGUAGES and "en" in first.languages
    assert first.languages == again.languages and np.allclose(first.weights, again.weights)
