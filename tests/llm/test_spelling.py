from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import spelling
from tests.llm import helpers

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows, damage=97, least_length=5, least_count=3):
    out = Counter()
    for i, text in rows:
        for w in LETTERS.findall((text or "").translate(FOLD)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * n else None
        out[w] = [forms[w], None, n, len(found), counts[best] if forms[w] else None]
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def random_words(rng, many, alphabet="abé"):
    letters = list(alphabet)
    return {"".join(rng.choice(letters, size=rng.integers(1, 8))): int(rng.integers(1, 40)) for _ in range(many)}


def test_counts_of_given_texts(spark, sf_dir):
    docs = helpers.documents(spark, sf_dir)
    want = plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.word: r.n for r in spelling.counted_words(docs).collect()} == want


@pytest.mark.parametrize("segment", [40, 1 << 20])
def test_odd_texts(spark, monkeypatch, segment):
    monkeypatch.setattr(spelling, "SEGMENT", segment)
    rows = [*((r[0], r[1]) for r in helpers.ODD), *((i, "Größe ÀÉÎ×÷ß straße STRASSE İstanbul Kelvin 𝔘nicode ſharp don't x" * 3) for i in range(40)), (100, "ab" * 300 + " " + "ab" * 300 + ". " + "ab" * 300), (None, "größe")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    for least, damage in ((1, 3), (5, 97), (1, None)):
        assert {r.word: r.n for r in spelling.counted_words(docs, least, 1, damage).collect()} == plain_counts(rows, damage, least, 1)


def test_empty(spark):
    docs = helpers.empty(spark)
    assert spelling.variants(spelling.counted_words(docs)).collect() == []


@pytest.mark.parametrize("group", [4, 4096])
def test_all_pairs_of_random_words(spark, monkeypatch, group):
    """Few letters, so that runs of equal ones let a word be reached in several ways; small groups are halved many times."""
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "BATCH", 30)
    counts = random_words(np.random.default_rng(group), 500)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(df)) == plain_variants(counts)


def test_long_words_and_chains(spark):
    long = "qwertz" * 700
    counts = {long: 100, long[:-1]: 9, long[1:]: 4, "x" + long[1:]: 4, "abcde": 64, "abcdf": 32, "abcgf": 16, "abhgf": 8, "aihgf": 4, "jihgf": 2, "zzzzz": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(spelling.variants(df))
    assert got == plain_variants(counts)
    assert got["jihgf"][:2] == ("aihgf", "abcde") and got[long[1:]][1] == long


def test_kernel_counts_each_pair_once():
    """Rests of m or m + 1 letters: once leaves out pairs that agree in the first m."""
    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 5):
        words = sorted({"".join(rng.choice(list("ab"), size=m + int(rng.integers(0, 2)))) for _ in range(60)})
        lengths = np.array([len(w) for w in words])
        letters = np.array([ord(c) - 97 for w in words for c in w])
        group = np.arange(len(words)) % 3
        for once in (False, True):
            many, best = spelling.near_words(letters, lengths, group, m, once)
            for i, a in enumerate(words):
                want = [j for j, b in enumerate(words) if group[i] == group[j] and near(a, b) and not (len(a) == len(b) == m + 1) and not (once and a[:m] == b[:m])]
                assert many[i] == len(want) and best[i] == (want[0] if want else -1)


def test_crcs_of_runs():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    cuts = np.unique(np.concatenate([rng.integers(0, 4000, 60), [0, 4000]]))
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(len(cuts) - 1)], np.uint32)
    got = spelling.run_crcs(data, cuts[:-1], cuts[1:], before)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
