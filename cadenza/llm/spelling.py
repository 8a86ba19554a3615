"""Spelling variants: words one inserted, deleted or replaced letter apart, by a bit-sliced position index.

An index over N words holds for every (position, letter) a bitset of N bits: the words with that letter there. A query word is compared
with all of them at once: letter by letter, bitwise recurrences carry the set of words that agree so far (no error) and those that agree but for
one replaced letter, one letter more or one letter less, the latter two by reading the bitsets one position on or back. Words are
numbered by falling count, then in code-point order, so the lowest bit of a result is the word's form, and the number of its bits the near words.

One index over all words would make the work grow with the square of the vocabulary. An error lies in one half of a word, so the other half
is whole: words are grouped by length and first half, and by length and second half, and only what remains of a word is indexed. A
group of more than GROUP words is halved again, by halves of what remains, until it is small enough; groups with one letter left are
bounded by the alphabet (90 letters, so 90 + 90 * 90 words at most). No pair is found twice: where the shared part is the second one, pairs that share the first one too are taken off.

Shuffles: the runs after partial counts; each word four times (two lengths, two halves), once more as often where its group is halved again; found forms by word.
A task holds one batch: groups of together BATCH words, or one group. No pairs leave a task, only each word's number of near words and its best one.

Defined results: a null text has no words; a null doc_id counts as an empty string in the hash that damages runs; rows that repeat a doc_id or text count
each. Long runs are words like others. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import in_arrow, small_side, staged, text_of
from cadenza.llm.textbytes import SEGMENT, column_bytes

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A run is damaged where this divides its hash.
DAMAGE = 97
#: Words of a group that is not halved again.
GROUP = 4096
#: Words and letters of a batch of groups.
BATCH = 2048
_LETTERS = 1 << 18
#: Words of state that a chunk of queries holds in each bitset.
_STATE = 1 << 14
#: Bytes of a run that are hashed along with other runs' bytes; longer ones are hashed alone.
_LONG = 64
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IS_LETTER = (_LOWERED >= 97) & (_LOWERED <= 122)


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, from its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run data[start:end] as it follows what has the CRC-32 before: byte by byte, all runs at once."""
    state, length = before ^ np.uint32(0xFFFFFFFF), ends - starts
    order = np.argsort(-length, kind="stable")
    state, at, length = state[order], starts[order], length[order]
    for j in range(min(int(length.max(initial=0)), _LONG)):
        n = int(np.searchsorted(-length, -j, side="left"))  # the runs that have a byte there
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> 8)
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(ends - starts > _LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _words_of(data: np.ndarray, edges: np.ndarray, before: np.ndarray, damage: int | None) -> pa.Array:
    """The words of rows data[edges[i]:edges[i + 1]]; before: the CRC-32 of what stands before a row's runs when they are hashed."""
    if not len(data):
        return pa.array([], pa.string())
    wide = data == 0xC3  # the first byte of U+00C0 to U+00FF, and of no other character
    inside = _IS_LETTER[data] | wide
    inside[1:] |= wide[:-1]
    data = _LOWERED[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = edges[(edges > 0) & (edges < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    held = np.concatenate([[0], np.cumsum(wide)])
    points = ends - starts - (held[ends] - held[starts])
    length, kept = ends - starts, np.flatnonzero(inside)
    if damage and len(starts):
        h = run_crcs(data, starts, ends, before[np.searchsorted(edges, starts, side="right") - 1]).astype(np.int64)
        gone = []
        for i in np.flatnonzero(h % damage == 0):
            heads = np.flatnonzero(data[starts[i] : ends[i]] & 0xC0 != 0x80)
            p = int(h[i] % points[i])
            a, b = heads[p], heads[p + 1] if p + 1 < len(heads) else length[i]
            gone.append(np.arange(starts[i] + a, starts[i] + b))
            length[i] -= b - a
        if gone:
            inside[np.concatenate(gone)] = False
            kept = np.flatnonzero(inside)
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(data[kept]))


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """word and n: runs of letters, A-Z in lower case, of at least that length and count. damage: a run loses a letter where this divides its hash with doc_id.

    Python counts the words of a piece of text (about SEGMENT bytes, cut between words), Spark adds the counts up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(data: np.ndarray, edges: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
            words = _words_of(data, edges, before, damage)
            counts = words.filter(pc.greater_equal(pc.utf8_length(words), least_length)).value_counts()
            if len(counts):
                yield pa.record_batch({"word": counts.field("values"), "n": counts.field("counts")})

        for batch in batches:
            data, at = column_bytes(batch.column(1))
            before = np.array([zlib.crc32(f"{i}:".encode()) for i in pc.fill_null(batch.column(0), "").to_pylist()], np.uint32)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT, side="right")) - 1)
                a, end = int(at[i]), int(at[j])
                while end - a > SEGMENT:  # one long text
                    b = a + SEGMENT
                    while b < end and (_IS_LETTER[data[b - 1]] or data[b - 1] >= 0x80):
                        b += 1
                    yield from counted(data[a:b], np.array([0, b - a]), before[i:j])
                    a = b
                yield from counted(data[a:end], np.maximum(at[i : j + 1] - a, 0), before[i:j])
                i = j

    parts = in_arrow(docs.select(F.col("doc_id").cast("string").alias("id"), text_of("text").alias("text")), run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: grouped by the first half of its rest, the second one remaining, and the other way round.

    A group holds words whose rests have m or m + 1 letters. once: pairs whose first m letters agree are left to another group.
    """
    k = F.floor(F.col("m") / 2).cast("int")
    size = F.length("rest")
    first = F.struct(F.concat("key", F.lit("<"), F.substring("rest", F.lit(1), k)).alias("key"), F.substring("rest", k + 1, size).alias("rest"), (F.col("m") - k).alias("m"), F.col("once").alias("once"))
    left = F.col("m") - k
    second = F.struct(F.concat("key", F.lit(">"), F.substring("rest", size - left + 1, left)).alias("key"), F.substring("rest", F.lit(1), size - left).alias("rest"), k.alias("m"), F.lit(True).alias("once"))
    return rows.select("word", "n", F.explode(F.array(first, second)).alias("half")).select("word", "n", "half.*")


def position_index(letters: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitsets of rows of letters (numbered from 0, rows one after the other): one row for each (position, letter) that occurs and
    one of zeros, and the row number of each position and letter."""
    n, kinds = len(lengths), int(letters.max(initial=0)) + 1
    owner = np.repeat(np.arange(n), lengths)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held, row = np.unique(place * kinds + letters, return_inverse=True)
    bits = np.zeros((len(held) + 1, -(-n // 64) * 64), np.bool_)
    bits[row, owner] = True
    at = np.full((width, kinds), len(held))
    at.reshape(-1)[held] = np.arange(len(held))
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), at


def near_words(letters: np.ndarray, lengths: np.ndarray, group: np.ndarray, m: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of m or m + 1 letters the number of rows of its group at one error from it, and the lowest such row (-1: none).

    Rows of m letters find replaced ones and those of m + 1 letters, rows of m + 1 letters those of m.
    """
    n = len(lengths)
    index, at = position_index(letters, lengths, m + 2)
    words = index.shape[1]
    flags = lambda which: np.packbits(np.pad(which, [(0, 0)] * (which.ndim - 1) + [(0, words * 64 - n)]), axis=-1, bitorder="little").view("<u8")
    short = flags(lengths == m)
    long = flags(lengths == m + 1)
    members = flags(group[None, :] == np.arange(group.max() + 1)[:, None])
    starts = np.cumsum(lengths) - lengths
    found, best = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    chunk = max(1, _STATE // words)
    for size, targets in ((m, None), (m + 1, short)):
        asked = np.flatnonzero(lengths == size)
        for s in range(0, len(asked), chunk):
            q = asked[s : s + chunk]
            same = members[group[q]]
            if size == m:
                swapped, more = np.zeros_like(same), same.copy()
                for i in range(m):
                    c = letters[starts[q] + i]
                    here = index[at[i, c]]
                    swapped &= here
                    swapped |= same & ~here
                    same &= here
                    more &= index[at[i + 1, c]]
                    more |= same
                more &= long
                if once:
                    more &= ~same
                hits = (swapped & short) | more
            else:
                less = np.zeros_like(same)
                for i in range(m + 1):
                    c = letters[starts[q] + i]
                    if i:
                        less &= index[at[i - 1, c]]
                    less |= same
                    if i < m:
                        same &= index[at[i, c]]
                hits = less & targets
                if once:
                    hits &= ~same
            found[q] = np.bitwise_count(hits).sum(axis=1)
            some = found[q] > 0
            hits, q = hits[some], q[some]
            word = (hits != 0).argmax(axis=1)
            low = hits[np.arange(len(q)), word]
            best[q] = word * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
    return found, best


def _solve(batch: pa.Table, group: np.ndarray, m: int, once: bool) -> pa.RecordBatch:
    order = pc.sort_indices(batch, sort_keys=[("n", "descending"), ("word", "ascending")])
    batch, group = batch.take(order).combine_chunks(), group[order.to_numpy()]
    points = np.frombuffer("".join(batch["rest"].to_pylist()).encode("utf-32-le"), "<u4")
    letters = np.unique(points, return_inverse=True)[1]
    found, best = near_words(letters, pc.utf8_length(batch["rest"]).to_numpy().astype(np.int64), group, m, once)
    some = np.flatnonzero(found)
    forms = pa.array(best[some])
    columns = {"word": batch["word"].take(pa.array(some)), "n_near": pa.array(found[some]), "form": batch["word"].take(forms), "form_n": batch["n"].take(forms)}
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], list(columns))


def _batches(rows: pa.Table) -> Iterator[tuple[int, int, bool]]:
    """Where batches of whole groups begin in sorted rows, where they end, and whether another group may follow in the last."""
    cut = np.flatnonzero(np.concatenate([[True], pc.not_equal(rows["key"][1:], rows["key"][:-1]).to_numpy()]))
    m, letters = rows["m"].to_numpy(), np.concatenate([[0], np.cumsum(pc.utf8_length(rows["rest"]).to_numpy())])
    once = rows["once"].to_numpy()
    start = 0
    for a, b in zip(cut, [*cut[1:], rows.num_rows], strict=True):
        if a > start and (b - start > BATCH or letters[b] - letters[start] > _LETTERS or m[a] != m[start] or once[a] != once[start]):
            yield start, a, False
            start = a
    yield start, rows.num_rows, True


def near_of_groups(rows: DataFrame) -> DataFrame:
    """For each word with near words in its group: their number and the best one (word, n_near, form, form_n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table, a: int, b: int) -> Iterator[pa.RecordBatch]:
            part = table.slice(a, b - a).combine_chunks()
            keys = pc.dictionary_encode(part["key"]).combine_chunks().indices.to_numpy()
            part, keys = part.filter(pa.array(np.bincount(keys)[keys] > 1)), keys[np.bincount(keys)[keys] > 1]  # a word alone has no near one
            if len(keys):
                out = _solve(part, np.unique(keys, return_inverse=True)[1], part["m"][0].as_py(), part["once"][0].as_py())
                if out.num_rows:
                    yield out

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            held = None
            for a, b, last in _batches(table):
                if last:
                    held = table.slice(a)  # its last group may go on
                else:
                    yield from solved(table, a, b)
        if held is not None:
            yield from solved(held, 0, held.num_rows)

    return in_arrow(rows.repartition("key").sortWithinPartitions("m", "once", "key"), run, "word string, n_near long, form string, form_n long")


def near_forms(words: DataFrame, least_length: int = 1) -> DataFrame:
    """For each word (unique, with its count n) that has near words: their number, and the one of largest n (ties: the first in code-point order)."""
    # a group of length m holds words of m letters and of one more; none is shorter than least_length
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")).where(F.col("m") >= least_length)
    rows = _halves(rows.select("word", "n", F.col("m").cast("string").alias("key"), F.col("word").alias("rest"), "m", F.lit(False).alias("once")))
    parts = []
    for level in range(64):
        hot = staged(rows.groupBy("key", "m").agg(F.count(F.lit(1)).alias("held")).where((F.col("held") > GROUP) & (F.col("m") > 1)).select("key"), f"spelling-hot-{level}")
        if hot.isEmpty():
            parts.append(near_of_groups(rows))
            break
        hot = small_side(hot)
        parts.append(near_of_groups(rows.join(hot, "key", "left_anti")))
        rows = _halves(rows.join(hot, "key", "left_semi"))
    found = reduce(DataFrame.unionAll, parts)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word and root for links word -> form without circles: each round doubles the links that a pointer spans."""
    now = staged(links.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(64):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = staged(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            break
    return now


def variants(words: DataFrame, times: int = 2, least_length: int = 1) -> DataFrame:
    """For each word (unique, with its count n): near words, form (the most frequent near word, if at least times as frequent) and root."""
    words = staged(words.select("word", "n"), "spelling-words")
    near = words.join(near_forms(words, least_length), "word", "left")
    good = F.col("form_n") >= times * F.col("n")
    near = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "spelling-near")
    joined = near.join(roots(near.where("form IS NOT NULL")), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted_words(spark.read.parquet(f"{sf_dir}/documents.parquet")), least_length=LEAST_LENGTH)


#: CRC-32 from its polynomial; near words by what is left when a letter is taken out (both words', or one's and the other word).
OP12_SQL = """
WITH RECURSIVE crc_bits AS (
  SELECT i AS b, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc_bits WHERE step < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE step = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, times, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i+1])::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM bytes, crc_table
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words
), cut AS (SELECT word, n, p, word[1:p-1] || word[p+1:] AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), near AS (
  SELECT w.word, w.n, count(p.near) AS n_near, arg_min(p.near, (-p.near_n, p.near)) AS best, max(p.near_n) AS best_n
  FROM words w LEFT JOIN pairs p ON w.word = p.word GROUP BY w.word, w.n
), forms AS (
  SELECT word, n, n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM near
), walk AS (
  SELECT word, word AS here, 0 AS step FROM forms
  UNION ALL
  SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON w.here = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word) r ON f.word = r.word
"""
