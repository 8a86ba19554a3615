"""Packing token sequences into windows by order-preserving dynamic programming.

A task reads its documents in the order they are stored, turns each into ids and lays them end to end in
blocks of about BLOCK_TOKENS. In a block, windows are cut at document ends (free), sentence ends (SENTENCE_CUT)
or, in stretches of more than a quarter of a window without either, at every 64th token (HARD_CUT). With f(i) the least cost of all before boundary i,

    f(i) = cut(i) + min over j of f(j) + padding(p_i - p_j),   0 < p_i - p_j <= size.

Padding is size less the length, so the minimum is that of f(j) + p_j over a sliding window, which a monotone queue
gives in constant time; lengths that are smaller powers of two need no padding but cost SHORT_WINDOW, and are tried besides.
Nothing is shuffled, and a task holds one block; a document longer than a block makes a block of its own.

Defined results: a null text is empty, and a document without ids is the closing id alone; rows that
repeat a doc_id are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm.common import in_arrow, sub_batches

SIZE = 2048
CLOSING_ID = 1
BLOCK_TOKENS = 1 << 18
SENTENCE_CUT = 4
HARD_CUT = 64
#: What a window costs that is short but a power of two, and so needs no padding.
SHORT_WINDOW = 8
#: Pieces between spaces whose ids a task remembers at most.
REMEMBERED = 250_000

#: A space between white space, or at the end after some: there the ids of pieces cannot be put together.
_ODD_SPACES = re.compile(r"\s (?:\s|$)")


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Remembered(dict):
    """piece: the ids of the piece with a space before it, as little-endian 32-bit numbers; the first ones met stay."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.encode(" " + piece)).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = out
        return out


class PieceTokenizer:
    """The ids that a byte-level BPE file of the tokenizers library gives, from the ids of the pieces between single spaces.

    Such a BPE never joins across a space that stands before other characters, so a text's ids are those of its
    pieces, and most pieces recur. The file's vocabulary, whose ids are in the order of its merges, drives tiktoken's
    encoder. Texts with special tokens or odd runs of white space are encoded whole by tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.encode = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.after = _Remembered(self.encode)
        self.ends_sentence = np.zeros(max(ranks.values()) + 2, dtype=bool)
        for token, i in ranks.items():
            self.ends_sentence[i] = token.endswith((b".", b"!", b"?", b"\n")) or token in (b'."', b'!"', b'?"')

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if _ODD_SPACES.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        head, *rest = text.split(" ")
        return np.frombuffer(array("I", self.encode(head)).tobytes() + b"".join(map(self.after.__getitem__, rest)), dtype="<u4")


def cuts(positions: np.ndarray, costs: np.ndarray, size: int = SIZE) -> list[int]:
    """Which boundaries to cut at, the last always: positions are ascending, the first 0, gaps at most size."""
    n = len(positions)
    number = np.full(int(positions[-1]) + 1, -1, dtype=np.int64)
    number[positions] = np.arange(n)
    # for each boundary those that lie a smaller power of two before it
    short_i, short_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range((size - 1).bit_length()):
        i = np.flatnonzero(positions >= 1 << k)
        j = number[positions[i] - (1 << k)]
        short_i.append(i[j >= 0])
        short_j.append(j[j >= 0])
    by_i = np.argsort(np.concatenate(short_i), kind="stable")
    short = np.concatenate(short_j)[by_i].tolist()
    first = np.searchsorted(np.concatenate(short_i)[by_i], np.arange(n + 1)).tolist()
    p, c = positions.tolist(), costs.tolist()
    total, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque()
    for i in range(1, n):
        key, here = total[i - 1] + p[i - 1], p[i]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i - 1))
        while p[queue[0][1]] < here - size:
            queue.popleft()
        best, j = queue[0]
        best += size - here
        for o in short[first[i] : first[i + 1]]:
            if total[o] + SHORT_WINDOW < best:
                best, j = total[o] + SHORT_WINDOW, o
        total[i], back[i] = best + c[i], j
    out, i = [], n - 1
    while i:
        out.append(i)
        i = back[i]
    return out[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Where a block may be cut, and at what cost."""
    cost = np.where(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)], SENTENCE_CUT, -1)
    cost[doc_ends - 1] = 0
    here = np.flatnonzero(cost >= 0)
    positions, costs = np.concatenate([[0], here + 1]), np.concatenate([[0], cost[here]])
    gaps = np.diff(positions)
    if (gaps > size // 4).any():  # room for a cut in long stretches without sentence ends
        more = np.concatenate([np.arange(positions[i] + 64, positions[i + 1], 64) for i in np.flatnonzero(gaps > size // 4)])
        order = np.argsort(np.concatenate([positions, more]), kind="stable")
        positions, costs = np.concatenate([positions, more])[order], np.concatenate([costs, np.full(len(more), HARD_CUT)])[order]
    return positions, costs


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(tokenizer_path: str, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = PieceTokenizer(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 33
        names, held, count = [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal sequence
            ids, lengths = np.concatenate(held), np.array([len(h) for h in held])
            ends = np.cumsum(lengths)
            positions, costs = boundaries(ids, ends, tokenizer.ends_sentence, size)
            windows = positions[cuts(positions, costs, size)]
            edges = np.unique(np.concatenate([[0], windows, ends]))
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, a, side="right")
            window = np.searchsorted(windows, a, side="right")
            before = np.concatenate([[0], windows])[window]
            out = pa.record_batch(
                {
                    "doc_id": pa.array([names[d] for d in doc], pa.int64()), "start": pa.array(a - (ends - lengths)[doc]), "length": pa.array(b - a), "ids_crc32": pa.array([crc32(ids[x:y].tobytes()) for x, y in zip(a, b, strict=True)], pa.int64()),
                    "doc_tokens": pa.array(lengths[doc]), "sequence_id": pa.array(window + sequence), "offset": pa.array(a - before),
                }
            )
            sequence += len(windows)
            return out

        closing = np.array([CLOSING_ID], dtype="<u4")
        for batch in sub_batches(batches, "text"):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                held.append(np.concatenate([tokenizer.ids(text), closing]))
                count += len(held[-1])
                if count >= BLOCK_TOKENS:
                    yield block()
                    names, held, count = [], [], 0
        if held:
            yield block()

    return pack


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_path: str | None = None, size: int = SIZE) -> DataFrame:
    """A row for each piece of a document: where it starts in the document's ids, and its sequence and place there."""
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return in_arrow(rows, _pack(path, size), _PIECES)


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
