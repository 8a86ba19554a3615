from __future__ import annotations

import random

import numpy as np

from cadenza.llm import substring_dedup
from tests.llm.helpers import empty, odd

WORDS = [a + b + c for a in ("ba", "ko", "mi", "tu", "re", "sal") for b in ("n", "rt", "l", "") for c in ("a", "en", "ost", "i", "ué")]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def planted(seed=1, pairs=60):
    rng, rows = random.Random(seed), []
    for _ in range(pairs):
        passage = prose(rng, 52)
        for _ in range(2):
            w = prose(rng, rng.randrange(60, 400))
            at = rng.randrange(len(w))
            rows.append((len(rows), " ".join(w[:at] + passage + w[at:]), " ".join(passage)))
    return rows, [(1000 + i, " ".join(prose(rng, 200))) for i in range(60)]


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    rows, clean = planted()
    docs = spark.createDataFrame([r[:2] for r in rows] + clean, "doc_id long, text string")
    found = substring_dedup.repeats(docs).collect()
    ids = {r.doc_id for r in found}
    assert not ids & {i for i, _ in clean}
    assert len(ids) >= 0.97 * len(rows)
    texts = {i: t.encode() for i, t, _ in rows}
    for r in found:
        assert r.keep_id == r.doc_id - r.doc_id % 2
        assert texts[r.doc_id][r.start : r.start + r.n_bytes].decode() in texts[r.keep_id].decode()


def test_repeats_are_cut_out_of_all_but_the_first(spark):
    rows, clean = planted(2, 20)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(*c, "x") for c in clean], "doc_id long, text string, start string")
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    after = {r.doc_id: r.text for r in out.collect()}
    assert len(after) == len(rows) + len(clean)
    assert all(after[i] == t for i, t in clean)
    assert all(after[i] == t for i, t, _ in rows if i % 2 == 0)
    assert sum(len(after[i]) < len(t) - 100 for i, t, _ in rows if i % 2) >= 18


def test_chunks_cover_the_text_and_resist_shifts():
    data = np.random.default_rng(5).integers(32, 126, 20_000).astype(np.uint8)
    ends = substring_dedup.chunk_ends(data)
    assert ends[-1] == len(data) and (np.diff(ends) > 0).all() and np.diff(ends).max() <= substring_dedup.MOST
    moved = substring_dedup.chunk_ends(np.concatenate([np.full(7, 65, np.uint8), data])) - 7
    assert len(set(ends.tolist()) & set(moved.tolist())) > 0.98 * len(ends)
    text = "é" * 3000
    raw = np.frombuffer(text.encode(), np.uint8)
    assert all((raw[e] & 0xC0) != 0x80 for e in substring_dedup.chunk_ends(raw)[:-1])


def test_odd_rows_and_copies(spark):
    assert substring_dedup.repeats(odd(spark)).count() == 0
    assert substring_dedup.repeats(empty(spark)).count() == 0
    rng = random.Random(3)
    text = " ".join(prose(rng, 300))
    docs = spark.createDataFrame([(i, text) for i in (4, 9, 2)] + [(20, text), (20, text)], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_bytes, r.keep_id) for r in substring_dedup.repeats(docs).collect()}
    assert got == dict.fromkeys((2, 4, 9, 20), (0, len(text.encode()), 2))


def test_copies_that_share_a_passage_with_an_earlier_document_survive(spark):
    rng = random.Random(11)
    text = " ".join(prose(rng, 300))
    raw = text.encode()
    ends = substring_dedup.chunk_ends(np.frombuffer(raw, np.uint8)).tolist()
    a, b = next((a, b) for a, b in zip(ends, ends[1:], strict=False) if a > 600 and b - a < 60)
    around = lambda passage: f"{' '.join(prose(rng, 150))} {passage} {' '.join(prose(rng, 150))}"
    short, long = (around(raw[a - 60 : b + n].decode(errors="ignore")) for n in (30, 600))
    for first, longest in ((short, 0), (long, 760)):
        docs = spark.createDataFrame([(1, first), (5, text), (9, text)], "doc_id long, text string")
        spans = [r for r in substring_dedup.repeats(docs).collect() if r.doc_id == 9]
        assert {r.keep_id for r in spans} == {1, 5} and sum(r.n_bytes for r in spans) == len(raw)
        after = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
        assert after[1] == first and after[9] == ""
        gone = len(raw) - len(after[5].encode())
        assert (gone == 0) if not longest else (500 < gone < longest)


def test_what_a_document_repeats_of_itself_stays_once(spark):
    rng = random.Random(21)
    passage, other = " ".join(prose(rng, 90)), lambda: " ".join(prose(rng, 150))
    text = f"{other()} {passage} {other()} {passage} {other()}"
    docs = spark.createDataFrame([(3, text), (3, text), (4, other())], "doc_id long, text string")
    spans = substring_dedup.repeats(docs).orderBy("start").collect()
    assert [(r.doc_id, r.keep_id, r.kept) for r in spans] == [(3, 3, True), (3, 3, False)]
    assert all(len(passage) * 0.6 < r.n_bytes <= len(passage) + 2 for r in spans)
    after = {r.text for r in substring_dedup.without_repeats(docs.dropDuplicates()).collect() if r.doc_id == 3}
    assert len(after) == 1 and len(after.pop().encode()) == len(text.encode()) - spans[1].n_bytes
    assert substring_dedup.repeats(docs, within=False).count() == 0


def common_runs(a: bytes, b: bytes, least: int):
    """All maximal common substrings of at least least bytes: where they lie in a and in b, and how long they are."""
    grams, out = {}, set()
    for j in range(len(b) - least + 1):
        grams.setdefault(b[j : j + least], []).append(j)
    for i in range(len(a) - least + 1):
        for j in grams.get(a[i : i + least], ()):
            if not (i and j and a[i - 1] == b[j - 1]):
                n = least
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                out.add((i, j, n))
    return out


def test_spans_are_held_against_all_common_substrings(spark):
    """Every pair of texts by brute force. Recall: common runs of 300 bytes or more that both texts' spans touch, and how much of
    them. Precision: bytes of spans that lie in a common run of at least 60 bytes with another text or place."""
    rng, texts = random.Random(31), {}
    shared = [" ".join(prose(rng, rng.randrange(25, 120))) for _ in range(12)]
    for i in range(40):
        parts = [" ".join(prose(rng, rng.randrange(10, 120))) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        texts[i] = " ".join(parts).encode()
    docs = spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string")
    spans = {i: [] for i in texts}
    for r in substring_dedup.repeats(docs).collect():
        spans[r.doc_id].append((r.start, r.start + r.n_bytes))
    true = {i: np.zeros(len(t), bool) for i, t in texts.items()}
    met = total = covered = bytes_ = 0
    for i in texts:
        for j in range(i + 1):
            for a, b, n in common_runs(texts[i], texts[j], 60):
                if i == j and a == b:
                    continue
                true[i][a : a + n] = True
                true[j][b : b + n] = True
                if n >= 300:
                    for k, at in ((i, a), (j, b)):
                        over = sum(max(0, min(at + n, e) - max(at, s)) for s, e in spans[k])
                        met, total, covered, bytes_ = met + (over > 0), total + 1, covered + min(over, n), bytes_ + n
    said = [true[i][s:e].mean() for i in texts for s, e in spans[i]]
    print("runs met", met / total, "bytes covered", covered / bytes_, "precision", np.mean(said))
    assert total > 40 and met == total
    assert covered / bytes_ > 0.75 and np.mean(said) > 0.99


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """No text is cut for the spans of another one of the same id; each is a document of its own."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage, other, unrelated = prose(120), prose(80), prose(200)
    rows = [(1, passage), (2, other + " " + passage), (2, unrelated), (2, unrelated), (3, prose(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    after = sorted((r.doc_id, r.text) for r in substring_dedup.without_repeats(docs).collect())
    assert [t for i, t in after if i in (1, 3)] == [passage, rows[4][1]]
    texts = [t for i, t in after if i == 2]
    assert texts.count(unrelated) == 2 and any(t.startswith(other[:-40]) and len(t) < len(other) + 120 for t in texts)
    # what two texts of one id share stays in one of them
    twice = spark.createDataFrame([(5, prose(60) + " " + passage), (5, passage + " " + prose(60))], "doc_id long, text string")
    spans = substring_dedup.repeats(twice).collect()
    assert sorted(r.kept for r in spans) == [False, True] and len({r.text_key for r in spans}) == 2
