from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import exact_dedup, golomb
from tests.llm.helpers import documents, empty, odd


@pytest.mark.parametrize("bits", [8, 20, 48])
@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_golomb_round_trip(n, bits):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << bits, n))
    k, code = golomb.encode(values)
    assert (golomb.decode(k, len(values), code) == values).all()


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True):
            out[(i, keep, len(ids), left and i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
            left = left and i != keep
    return out


@pytest.mark.parametrize("bits", [48, 24])
def test_same_groups_as_a_dictionary(spark, sf_dir, bits):
    for docs in (odd(spark), odd(spark).union(odd(spark)), documents(spark, sf_dir), empty(spark)):
        got = exact_dedup.dedup(docs, bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert Counter(map(tuple, got)) == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_shared_fingerprints_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(5000, "text 7")], "doc_id long, text string")
    rows = exact_dedup.dedup(docs, bits=24, owners=3).where("group_size > 1").collect()
    assert {r.doc_id for r in rows} == {7, 5000}


def test_keep_one_keeps_the_columns_and_one_of_each(spark):
    docs = odd(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})
    assert exact_dedup.keep_one(empty(spark)).count() == 0
