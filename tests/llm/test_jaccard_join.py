from __future__ import annotations

import random
import time

import numpy as np
import pytest

from cadenza.llm import components, jaccard_join, textbytes
from tests.llm.brute import FOLD, WORD, jaccard_components, shingles
from tests.llm.helpers import documents, empty, odd


def test_word_and_shingle_hashes_agree_with_plain_words():
    import pyarrow as pa

    texts = ["One two\tTHREE  two one", "", "ÀB àb", " x ", "a" * 30, "one two three"]
    data, at = textbytes.column_bytes(pa.array(texts))
    starts, ends, first = textbytes.words(data, at)
    words = [bytes(data[a:b]).decode().translate(FOLD) for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in WORD.findall(t.translate(FOLD))]
    hashes = textbytes.run_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    for i, t in enumerate(texts):
        assert len(textbytes.shingle_hashes(hashes[first[i] : first[i + 1]], 3)) == len(shingles(t, 3))


def test_long_runs_hash_like_short_segments(monkeypatch):
    data = np.random.default_rng(0).integers(97, 123, 5000).astype(np.uint8)
    whole = textbytes.run_hashes(data, np.array([0]), np.array([5000]))
    monkeypatch.setattr(textbytes, "SEGMENT", 64)
    assert textbytes.run_hashes(data, np.array([0]), np.array([5000])) == whole


def near_copies(n=60, seed=4):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for g in range(n // 6):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 120, 700]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1000 + 1000 * g, " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard_join, "COUNTERS", 1 << 22)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == jaccard_components(rows, k, percent)


def test_blocks_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 3)
    rows = near_copies(48, 9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == jaccard_components(rows, 3, 80)


def test_large_clusters_and_groups_that_link_only_in_part(spark, monkeypatch):
    """Near copies beside texts just under the threshold, with blocks and groups so small that all parts of the join take part."""
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 5)
    monkeypatch.setattr(jaccard_join, "SMALL_GROUP", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 4)
    rng, rows = random.Random(12), []
    words = [f"w{i}" for i in range(300)]
    for g in range(4):
        base = [rng.choice(words) for _ in range(120)]
        for i in range(24):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 7, 8, 20])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((1000 * g + 37 * i % 101, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 80), (1, 90)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, k, percent).collect()}
        assert got == jaccard_components(rows, k, percent)
        assert 8 < len({c for _, c in got.values()}) < len(rows)


def test_rows_that_repeat_an_id_with_other_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(3, a), (7, a), (7, b), (9, b), (11, ""), (12, None), (9, ""), (20, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 3, 90).collect())
    assert got == [(3, 4, 3), (7, 4, 3), (7, 4, 3), (9, 0, 3), (9, 4, 3), (11, 0, 11), (12, 0, 12), (20, 1, 20)]
    assert sorted(r.doc_id for r in jaccard_join.keep_one(docs, 3, 90).collect()) == [3, 11, 12, 20]


def test_given_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 3, 90).collect()}
    assert got == jaccard_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 3, 90)


def test_odd_rows_and_empty_table(spark):
    docs = odd(spark)
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 3, 90).collect()}
    assert {(1, 5, 1), (5, 5, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (7, 1, 7)} <= rows
    assert (None, 4, None) in rows or any(r[0] is None and r[2] is None for r in rows)
    kept = jaccard_join.keep_one(docs, 3, 90)
    assert kept.columns == docs.columns
    assert 5 not in {r.doc_id for r in kept.collect()}
    assert jaccard_join.join(empty(spark)).count() == 0


def test_prefixes_share_as_many_as_they_ask_for():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, jaccard_join.COUNTERS)
    for _ in range(200):
        both, n, m = rng.integers(-(1 << 62), 1 << 62, 90), *rng.integers(0, 12, 2)
        a, b = (np.unique(np.concatenate([both, rng.integers(-(1 << 62), 1 << 62, extra)])) for extra in (n, m))
        if 100 * len(both) >= 80 * (len(a) + len(b) - len(both)):
            (ma, pa), (mb, pb) = (jaccard_join.prefix(x, counts, float(counts.mean()), 80) for x in (a, b))
            assert len(np.intersect1d(pa, pb)) >= min(ma, mb)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_long_near_copies_send_little(spark):
    """What is shuffled grows with the text, not with its square: shingles of the same documents stand for each other."""
    rng = random.Random(4)

    def moved():
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    def shuffled(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts = []
        for _ in range(4):
            t = list(base)
            for _ in range(n // 200):
                t[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(t))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        time.sleep(0.5)
        before = moved()
        assert {r.component_id for r in jaccard_join.join(df, k=3, percent=90).collect()} == {0}
        time.sleep(0.5)
        return moved() - before, sum(map(len, texts))

    sent, size = shuffled(20_000)
    assert sent < 5 * size


def test_prefix_shingles_are_shuffled_once_and_told_by_their_members(spark):
    rows = [(1, 10), (2, 10), (1, 11), (2, 11), (1, 12), (3, 12), (4, 13), (5, 14), (5, 14), (1, 15), (5, 15), (5, 15), (7, 15), (1, 16), (6, 16), (6, 16), (7, 16)]
    found = jaccard_join.shared_tokens(spark.createDataFrame(rows, "rep long, token long").repartition(3))
    got = {}
    for r in found.collect():
        got.setdefault((r.members, r.low, r.who, r.too), {}).setdefault(r.token, []).append(r.rep)
    assert sorted(sorted(g) for g in got.values()) == [[10, 11], [12], [14], [15], [16]]  # 13 has one member; twice 5 is not twice 6
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(token") == 1


def watched_tables(monkeypatch, *modules):
    """The names and rows of all tables that the modules stage from now on."""
    made = []
    for module in modules:

        def noted(df, name, put=module.staged):
            made.append((name, df))
            return put(df, name)

        monkeypatch.setattr(module, "staged", noted)
    return made


def test_few_edges_take_no_rounds_and_many_the_same_components(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(2000 + i, 2001 + i) for i in range(50)] + [(5, 5), (6, 5), (5, 6)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5).cache()
    least = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    made = watched_tables(monkeypatch, components)
    assert {r.node: r.component for r in components.components(edges).collect()} == least
    assert not [name for name, _ in made if name.endswith(("-large", "-small"))]
    monkeypatch.setattr(components, "PART_EDGES", 40)
    got = components.components(edges).collect()
    assert {r.node: r.component for r in got} == least
    assert len(got) == len(least)
    assert [name for name, _ in made if name.endswith("-large")]


def test_heads_that_all_met_are_not_compared_again(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 12)
    rng, words = random.Random(12), [f"w{i}" for i in range(300)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6, 7])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    made, turns = watched_tables(monkeypatch, jaccard_join), []
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == jaccard_components(rows, 3, 80)
    for name, df in made:
        if name == "cluster-heads":
            turns.append(df.agg({"members": "max"}).first()[0])
        elif name == "links" and turns and turns[-1]:
            turns.append("links")
    first = next(i for i, t in enumerate(turns) if t and t != "links" and t <= 12)
    assert turns[first:].count("links") <= 2  # one turn of heads, and what is left across blocks


def test_prefixes_that_nothing_asks_for_are_not_shuffled(spark, monkeypatch):
    made = watched_tables(monkeypatch, jaccard_join)
    jaccard_join.join(spark.createDataFrame(near_copies(12), "doc_id long, text string"), 3, 90)
    plan = next(df for name, df in made if name == "met-profiles")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" not in plan.split("Join LeftSemi")[0]
    assert "CASE WHEN" in plan.split("Join LeftSemi")[1]


def test_small_tasks_leave_collecting_to_later_ones(monkeypatch):
    import pyarrow as pa

    from cadenza.llm import common

    runs = []
    monkeypatch.setattr(common.gc, "collect", lambda: runs.append(1))
    for n, times in ((10, 0), (200_000, 1)):
        batch = pa.record_batch({"x": pa.array(range(n), pa.int64())})
        assert list(common.lean(lambda batches: batches)(iter([batch]))) == [batch]
        assert len(runs) == times
