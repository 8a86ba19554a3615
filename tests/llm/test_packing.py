from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadenza.llm import packing
from tests.llm.helpers import documents, empty, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE, PIECES = Tokenizer.from_file(PATH), packing.PieceTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r abcXYZ.,!?'09éß½²中🙂\x1c ")) | st.characters(codec="utf-8"), max_size=30))
def test_pieces_give_the_ids_of_the_tokenizer(text):
    assert PIECES.ids(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "a   b", "a  ", "\t \t b", "don't 's", " a", ""])
def test_special_tokens_and_odd_spaces(text):
    assert PIECES.ids(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def cost(positions, costs, chosen, size):
    total, before = 0, 0
    for i in chosen:
        n = positions[i] - before
        if n > size:
            return float("inf")
        pad = size - n
        if n < size and n & (n - 1) == 0:
            pad = min(pad, packing.SHORT_WINDOW)
        total, before = total + pad + costs[i], positions[i]
    return total


@pytest.mark.parametrize("seed", range(25))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    positions = np.concatenate([[0], np.cumsum(rng.integers(1, 12, 9))])
    costs = np.concatenate([[0], rng.choice([0, 4, 64], 9)])
    got = packing.cuts(positions, costs, 16)
    last = len(positions) - 1
    best = min(cost(positions, costs, [*c, last], 16) for k in range(last) for c in combinations(range(1, last), k))
    assert cost(positions, costs, got, 16) == best


def check(docs):
    rows = packing.pack(docs).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        ends = 0
        for offset, n in sorted(pieces):
            assert offset == ends
            ends += n
        assert ends <= packing.SIZE
    return rows


def test_every_id_lies_in_one_piece_and_padding_is_little(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = check(docs)
    texts, by_doc = dict(docs.select("doc_id", "text").collect()), {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    lengths = {}
    for r in rows:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    padding = sum(0 if n & (n - 1) == 0 else packing.SIZE - n for n in lengths.values())
    assert padding < 0.02 * sum(lengths.values())


def test_odd_rows_a_long_sentence_and_no_rows(spark):
    rows = check(odd(spark))
    assert [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    long = spark.createDataFrame([(1, "word " * 30_000)], "doc_id long, text string")
    assert sum(r.length for r in check(long)) == len(WHOLE.encode("word " * 30_000).ids) + 1
    assert packing.pack(empty(spark)).count() == 0
