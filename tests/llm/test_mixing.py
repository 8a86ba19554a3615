from __future__ import annotations

from collections import Counter

import pytest

from cadenza.llm import mixing
from tests.llm.helpers import documents, empty, odd


def water_filling(sizes: dict, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, free, targets = float(sum(sizes.values())), set(names), {}
    while free:
        share = (total - sum(targets.values())) / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > most * sizes[s]}
        if not over:
            return targets | {s: share * w[s] for s in free}
        targets |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return targets


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 10}, {"a": 3}, {"x": 10, "y": 1, "z": 1, "zz": 1}])
def test_targets_are_those_of_repeated_resharing(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "__cz_source string, __cz_size long")
    got = {r[0]: r[2] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(water_filling(sizes))


def test_odd_rows_and_empty_table(spark):
    docs = odd(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0
    again = Counter(map(repr, mixing.mix(docs).collect()))
    assert again == Counter(map(repr, mixed.collect()))
    assert max(again.values()) <= 2 * mixing.MAX_REPEATS  # the row that is there twice


def test_copies_follow_the_rates(spark, sf_dir):
    rows = mixing.op1_mix_sources(spark, sf_dir).collect()
    assert len(rows) == documents(spark, sf_dir).count()
    assert all(r.taken <= 3 * r.size for r in rows)
    taken = sum(r.taken for r in rows)
    assert taken == pytest.approx(sum(r.size for r in rows), rel=0.2)


def test_native_plan(spark, sf_dir):
    plan = mixing.op1_mix_sources(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
