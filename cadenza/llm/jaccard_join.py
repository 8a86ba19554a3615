"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct k-word shingles as 64-bit hashes. All sets are put in one order: rare
shingles first, by counts over all documents. If two sets share at least t shingles, the first n - t + m
of each have m in common (t: the least overlap that a set of n can have with a partner). So a document whose
prefix is m - 1 longer asks its partners for m shared prefix shingles. Every document chooses its own m by estimated
cost, and a pair asks for the smaller of its two.

Steps, each written to the shared folder:

1. Counts: every task adds up shingle counts in COUNTERS hashed counters; the sums (a fixed size) go to all tasks.
2. Profiles: per document the digest of its set, its size, m, its prefix, and a parity bitmap.
   Equal sets become one class, stood for by its smallest id.
3. Matching: prefix shingles that occur in one class only are dropped, and of shingles that occur in the same classes (told by their number, their least
   id and sums of their ids' hashes) all but one. The others form small groups of narrow rows: a bitmap of 512 bytes at most, and a prefix of
   LONG_PREFIX shingles and a few, if any (longer ones ask for one match). Groups over GROUP_ROWS rows are dealt into blocks that are matched each for itself. A pair becomes a candidate only if its sizes, its
   parity bitmaps (an upper bound of the overlap) and its shared prefix shingles allow a link. A group sends on a spanning
   forest of its candidates, not all pairs.
4. Verification: candidates that hang together form a cluster; its members' sets are computed again from their texts
   and compared exactly, a cluster of more than BLOCK_DOCS members in blocks, each for itself. Of each set of members that links join
   one stands for all in the next turn, until turns join no more: so a cluster of near copies sends every set about once.
5. What is left: pairs with different labels (a label: what links have joined so far) in large groups and in large clusters of
   more than one label. Only these are matched and verified across blocks: the rows of a group's most common label lie in one block each,
   and the others, mostly few, visit all blocks.
6. The links' connected components are found by distributed rounds.

No candidate is dropped other than by a bound that proves that it is no link, or because links join its two already, so the
components are those of all links. The worst case, a large cluster of texts that are all just under the threshold, costs time in
many tasks, but no task holds more than two blocks.

Defined results: a null or empty text, or one of white space only, has an empty set and is linked with nothing; a
text of fewer than k words has one shingle, the whole sequence; rows that repeat a doc_id count as one
document with the links of all its texts, so all of them get one component; a row without doc_id is linked with nothing. An empty table gives an empty result. Columns whose names begin with __cz_ are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import by_groups, in_arrow, small_side, staged, sub_batches
from cadenza.llm.components import components
from cadenza.llm.textbytes import column_bytes, run_hashes, shingle_hashes, words

COUNTERS = 1 << 22
_SLICES = 64
#: A parity bitmap has about half as many bits as the set has shingles, within these bounds: one travels with each group that a set is in.
BITMAP_BITS = (256, 1 << 12)
MOST_MATCHES = 4
#: A longer prefix would cost more to send along (once for each group) than asking for several matches can save.
LONG_PREFIX = 128
#: Estimated cost of comparing two prefixes, in units of reading one row of a group.
VERIFY_COST = 8.0
GROUP_ROWS = 2048
#: Groups of at most this many rows are matched many at a time.
SMALL_GROUP = 48
BLOCK_DOCS = 128


def _sets(batches: Iterator[pa.RecordBatch], k: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in sub_batches(batches, column):
        data, at = column_bytes(batch.column(batch.schema.get_field_index(column)))
        starts, ends, first = words(data, at)
        hashes = run_hashes(data, starts, ends)
        yield batch, [shingle_hashes(hashes[first[i] : first[i + 1]], k) for i in range(batch.num_rows)]


def _counter(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(42)).astype(np.int64)


def shingle_counts(docs: DataFrame, text_column: str, k: int) -> np.ndarray:
    """How many documents have shingles of each counter: COUNTERS numbers, whatever the input.

    A task sends its counts as bytes, and those over 254 as pairs of place and rest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int32)
        for _, sets in _sets(batches, k):
            place, times = np.unique(_counter(np.concatenate(sets)), return_counts=True)
            total[place] += times.astype(np.int32)
        if total.any():
            parts = total.reshape(_SLICES, -1)
            over = [np.flatnonzero(p > 254) for p in parts]
            pairs = [np.stack([o, p[o] - 254]).tobytes() for o, p in zip(over, parts, strict=True)]
            yield pa.record_batch({"slice": pa.array(range(_SLICES), pa.int32()), "low": pa.array([np.minimum(p, 254).astype(np.uint8).tobytes() for p in parts], pa.binary()), "rest": pa.array(pairs, pa.binary())})

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in tables:
            for s, low, rest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                total = sums.setdefault(s, np.zeros(COUNTERS // _SLICES, dtype=np.int64))
                total += np.frombuffer(low.as_buffer(), dtype=np.uint8)
                place, more = np.frombuffer(rest.as_py(), dtype=np.int64).reshape(2, -1)
                total[place] += more
        if sums:
            counts = [np.minimum(v, (1 << 31) - 1).astype(np.int32).tobytes() for v in sums.values()]
            yield pa.record_batch({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array(counts, pa.binary())})

    partial = in_arrow(docs.select(F.col(text_column).alias("text")), count, "slice int, low binary, rest binary")
    out = np.zeros((_SLICES, COUNTERS // _SLICES), dtype=np.int32)
    for row in in_arrow(partial.repartition(_SLICES, "slice"), add, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(row["counts"], dtype=np.int32)
    return out.ravel()


def least_overlap(n: int, percent: int) -> int:
    """The least number of shared shingles with which a set of n can link: 100 * both >= percent * either."""
    return -(-n * percent // 100)


def prefix(h: np.ndarray, counts: np.ndarray, usual: float, percent: int) -> tuple[int, np.ndarray]:
    """m and the prefix of a set: its first n - t + m shingles in the common order. usual is the mean count."""
    n = len(h)
    base = n - least_overlap(n, percent) + 1
    most = min(n, base + MOST_MATCHES - 1)
    often = counts[_counter(h)]
    if most < n:
        part = np.argpartition(often, most - 1)
        bound = often[part[most - 1]]
        near = np.flatnonzero(often <= bound)
    else:
        near = np.arange(n)
    order = near[np.lexsort((h[near], often[near]))][:most]
    lists = np.cumsum(np.maximum(often[order] - usual, 0.0))
    m = 1 if base > LONG_PREFIX else 1 + int(np.argmin([lists[base + i - 2] * (1 + VERIFY_COST / i) for i in range(1, most - base + 2)]))
    return m, h[order[: base + m - 1]]


def parity(h: np.ndarray) -> np.ndarray:
    """Bit b: whether an odd number of the shingles fall on b. Two sets differ in as many shingles at least as bits."""
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << (len(h) - 1).bit_length() >> 1 if len(h) else 1))
    odd = np.bincount((h.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def spanning(n: int, rows: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that has, for each given i, edges to the nodes given with it."""
    label, out = np.arange(n), []
    for i, others in rows:
        new = others[label[others] != label[i]]
        if len(new):
            met, first = np.unique(label[new], return_index=True)
            out += [(i, int(j)) for j in new[first]]
            label[np.isin(label, met)] = label[i]
    return out


def tops(rep: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """For each place that of the smallest rep among those that edges (pairs of places) join it to."""
    up = list(range(len(rep)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in edges:
        x, y = top(i), top(j)
        if x != y:
            x, y = (x, y) if rep[x] <= rep[y] else (y, x)
            up[y] = x
    return np.array([top(i) for i in range(len(rep))], dtype=np.int64)


def stars(rep: np.ndarray, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the nodes that edges (pairs of places) join, each with the smallest of them; places of one rep are one node."""
    order = np.argsort(rep, kind="stable")
    same = np.flatnonzero(rep[order[1:]] == rep[order[:-1]])
    held = tops(rep, [*edges, *zip(order[same].tolist(), order[same + 1].tolist(), strict=True)])
    return [(int(a), int(b)) for a, b in zip(rep, rep[held], strict=True) if a != b]


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _folded(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """All rows' bitmaps folded to size bytes (none is shorter); folding halves together keeps the parity."""
    widths = np.diff(at)
    out = np.zeros((len(widths), size), dtype=np.uint8)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        for some in np.array_split(rows, max(1, len(rows) * int(w) >> 22)):
            out[some] = np.bitwise_xor.reduce(raw[at[some][:, None] + np.arange(w)].reshape(len(some), -1, size), axis=1)
    return out


def _pairs_within(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs within each of the groups."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes):
        i, j = np.triu_indices(int(n), 1)
        at = starts[sizes == n][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _match(percent: int):
    """Candidates among the rows of each group (or between the two sides of one) with different labels: each row with the smallest one
    that candidates join it to."""

    def match(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        rep, n, m, side, label = (table[c].to_numpy() for c in ("rep", "n", "m", "side", "label"))
        raw, at = column_bytes(table["bitmap"].chunk(0))
        prefixes = table["prefix"].chunk(0)
        least = BITMAP_BITS[0] // 8

        def bitmap(i: int, size: int) -> np.ndarray:
            """Row i's bitmap of size bytes."""
            out = raw[at[i] : at[i + 1]]
            while len(out) > size:
                out = out[: len(out) // 2] ^ out[len(out) // 2 :]
            return out.view(np.uint64)

        def near(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
            """Whether sets that differ in so many bits may link."""
            total = n[i] + n[j]
            both = total - apart  # twice the overlap at most
            return 100 * both >= percent * (2 * total - both)

        def sharing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether two rows share as many prefix shingles as the pair asks for."""
            ask = np.minimum(m[i], m[j])
            out = ask <= 1
            for some in np.array_split(np.flatnonzero(~out), max(1, int((~out).sum()) >> 11)):
                held = prefixes.take(pa.array(np.concatenate([i[some], j[some]])))
                pair = np.repeat(np.tile(np.arange(len(some)), 2), held.value_lengths().to_numpy(zero_copy_only=False))
                values = held.flatten().to_numpy()
                order = np.lexsort((values, pair))
                again = (np.diff(values[order]) == 0) & (np.diff(pair[order]) == 0)
                out[some] = np.bincount(pair[order[1:][again]], minlength=len(some)) >= ask[some]
            return out

        def few(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The candidates of small groups, all of them at once."""
            i, j = _pairs_within(sizes, starts)
            ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            ok &= ~crossed[i] | (side[i] != side[j])
            i, j = i[ok], j[ok]
            ok = near(i, j, np.bitwise_count(small[i] ^ small[j]).sum(axis=1, dtype=np.int64))
            i, j = i[ok], j[ok]
            widths = np.minimum(np.diff(at)[i], np.diff(at)[j])
            ok = widths <= least
            wide = np.flatnonzero(~ok)
            ok[wide] = near(i[wide], j[wide], np.array([np.bitwise_count(bitmap(a, w) ^ bitmap(b, w)).sum(dtype=np.int64) for a, b, w in zip(i[wide].tolist(), j[wide].tolist(), widths[wide].tolist(), strict=True)], dtype=np.int64))
            i, j = i[ok], j[ok]
            ok = sharing(i, j)
            return i[ok], j[ok]

        def rows(order: np.ndarray, across: bool):
            """For each row of a group (in the order of n) the later rows that may link with it, as places in the order."""
            size = n[order]
            limit = np.searchsorted(size, size * 100 // percent, side="right")
            width = np.diff(at)[order]
            stacks: dict[int, tuple[int, int, np.ndarray]] = {}
            for i in range(len(order) - 1):
                hi = int(limit[i])
                if hi <= i + 1:
                    continue
                w = int(width[i])
                top = max(hi, int(np.searchsorted(width, w, side="right")))
                if w not in stacks or stacks[w][0] < top:
                    low = int(np.searchsorted(width, w))
                    stacks = {w: (top, low, np.stack([bitmap(int(x), w) for x in order[low:top]]))}
                _, low, stack = stacks[w]
                j = np.arange(i + 1, hi)
                ok = label[order[j]] != label[order[i]]
                if across:
                    ok &= side[order[j]] != side[order[i]]
                j = j[ok]
                if not len(j):
                    continue
                apart = np.bitwise_count(stack[j - low] ^ stack[i - low]).sum(axis=1, dtype=np.int64)
                j = j[near(np.full(len(j), order[i]), order[j], apart)]
                if len(j):
                    j = j[sharing(np.full(len(j), order[i]), order[j])]
                yield i, j

        sizes = np.diff(cuts)
        second = np.add.reduceat(side, cuts[:-1])
        crossed = np.repeat((second > 0) & (second < sizes), sizes)  # groups of two sides
        small_groups = sizes <= SMALL_GROUP
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if small_groups.any():
            small = _folded(raw, at, least)
            starts, counts = cuts[:-1][small_groups], sizes[small_groups]
            for some in np.array_split(np.arange(len(starts)), max(1, int((counts * (counts - 1) // 2).sum()) >> 16)):
                if not len(some):
                    continue
                i, j = few(starts[some], counts[some])
                group = np.searchsorted(starts, i, side="right")
                alone = np.bincount(group, minlength=len(starts) + 1)[group] == 1
                found_a.append(rep[i[alone]])
                found_b.append(rep[j[alone]])
                nodes, places = np.unique(np.concatenate([i[~alone], j[~alone]]), return_inverse=True)
                # places of one row, so that a repeated rep in two groups does not join them here
                held = tops(rep[nodes], places.reshape(2, -1).T.tolist())
                found_a.append(rep[nodes])
                found_b.append(rep[nodes[held]])
        for a, b in zip(cuts[:-1][~small_groups], cuts[1:][~small_groups], strict=True):
            order = a + np.argsort(n[a:b], kind="stable")
            across = bool(crossed[a])
            held = tops(rep[order], spanning(b - a, rows(order, across)))
            found_a.append(rep[order])
            found_b.append(rep[order[held]])
        left, right = np.concatenate(found_a), np.concatenate(found_b)
        return _edges(left[left != right], right[left != right])

    return match


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 2048) -> np.ndarray:
    """The numbers of shared elements of each left and each right set, by products of 0/1 matrices over shared elements."""
    sizes = np.array([len(s) for s in sets])
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left], dtype=np.int64)
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(place)
    column = np.cumsum(often > 1) - 1
    shared = often[place] > 1
    owner, place = owner[shared], column[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(place, [c, c + columns])
        dense = np.zeros((len(sets), columns), dtype=np.float32)
        dense[owner[a:b], place[a:b] - c] = 1
        out += dense[left] @ dense[right].T
    return out.astype(np.int64)


def _verify(percent: int, whole: bool):
    """The links of different labels among a block of a cluster, or between two sides, as a spanning forest; or, where blocks do not
    overlap (whole), each member with the smallest one that links lead to."""

    def verify(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        reps, sides, labels, raw = table["rep"].to_numpy(), table["side"].to_numpy(), table["label"].to_numpy(), table["hashes"].chunk(0)
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rep, side, label = reps[a:b], sides[a:b], labels[a:b]
            data, at = column_bytes(raw.slice(a, b - a))
            sets = [data[at[i] : at[i + 1]].view(np.int64) for i in range(b - a)]
            sizes = np.array([len(s) for s in sets])
            across = (side == 0).any() and (side == 1).any()
            left = np.flatnonzero(side == 0) if across else np.arange(len(rep))
            right = np.flatnonzero(side == 1) if across else left
            both = overlaps(sets, left, right)
            linked = (100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)) & (label[left][:, None] != label[right][None, :])
            edges = spanning(len(rep), ((int(left[i]), right[linked[i] & (right != left[i])]) for i in range(len(left))))
            out += stars(rep, edges) if whole else [(rep[i], rep[j]) for i, j in edges]
        return _edges([a for a, _ in out], [b for _, b in out])

    return verify


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (with members, the size of their group) for grouping by group, x and y: large groups are dealt into blocks of about size."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / size).cast("int"))
    return rows.withColumns({"x": F.pmod(F.xxhash64("rep"), blocks).cast("int"), "y": F.lit(0), "side": F.lit(0)}).drop("members")


def in_block_pairs(rows: DataFrame, size: int) -> DataFrame:
    """rows (with members, the size of their group) for grouping by group, x and y: whole small groups, and for larger ones each
    pair of blocks (x <= y). side tells the two blocks of a pair apart."""
    return (
        rows.withColumn("blocks", F.ceil(F.col("members") / size).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
        .drop("own", "other", "blocks", "members")
    )


def across_labels(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows (key, rep, label and more) for grouping by key, x and y, so that any two rows of a key with different labels meet.

    Keys of one label go. Of a large key the rows of its most common label are dealt into blocks, which all other rows visit
    (y = -1, side tells them apart); the others also meet among themselves, by pairs of blocks.
    """
    per = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("members"), F.max("n").alias("most")).where("members > most")
    placed = rows.join(small_side(staged(top, "labelled-groups")), key)
    own = placed.columns[: len(rows.columns)]
    columns = [*rows.columns, "x", "y", "side"]
    whole = placed.where(F.col("members") <= size).withColumns({"x": F.lit(0), "y": F.lit(0), "side": F.lit(0)})
    large = placed.where(F.col("members") > size).withColumn("blocks", F.ceil(F.col("most") / size).cast("int"))
    common = large.where("label = top").withColumns({"x": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "y": F.lit(-1), "side": F.lit(0)})
    others = large.where("label <> top")
    visits = others.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"y": F.lit(-1), "side": F.lit(1)})
    among = in_block_pairs(others.select(*own, (F.col("members") - F.col("most")).alias("members")), size)
    return whole.select(*columns).unionByName(common.select(*columns)).unionByName(visits.select(*columns)).unionByName(among.select(*columns))


def profiles(docs: DataFrame, shared: Broadcast, k: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """A row for each row of docs: doc_id, n, the digest of the set (d1, d2), m, prefix and bitmap."""
    usual = float(shared.value.mean())

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, k):
            d1, d2, m, tokens, bitmaps = [], [], [], [], []
            for h in sets:
                digest = xxhash.xxh3_128_digest(h.tobytes())
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                matches, first = prefix(h, shared.value, usual, percent) if len(h) else (0, h)
                m.append(matches)
                tokens.append(first)
                bitmaps.append(parity(h).tobytes())
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), flat)
            yield pa.record_batch(
                {"doc_id": batch.column(0), "n": pa.array([len(h) for h in sets], pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "m": pa.array(m, pa.int32()), "prefix": lists, "bitmap": pa.array(bitmaps, pa.binary())}
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return in_arrow(rows, profile, "doc_id long, n long, d1 long, d2 long, m int, prefix array<long>, bitmap binary")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """Of tokens (rep, token) those that several rows have, with what tells their members: how many there are, the least of them, and two sums of
    hashes. The rows are shuffled once, as two numbers each, and what nothing shares goes before anything else is made of it."""
    of = W.partitionBy("token")
    h = F.xxhash64("rep")  # sums of 32 bits: 2^31 members do not overflow
    told = {"members": F.count(F.lit(1)).over(of), "low": F.min("rep").over(of), "who": F.sum(F.shiftright(h, 32)).over(of), "too": F.sum(h.bitwiseAND(F.lit((1 << 32) - 1))).over(of)}
    return tokens.withColumns(told).where("members > 1")


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles and component_id, the smallest doc_id that links lead to."""
    counts = shingle_counts(docs, text_column, k)
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers
    made = staged(profiles(docs, shared, k, percent, id_column, text_column), "profiles")
    shared.destroy()
    classes = staged(made.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    several = small_side(classes.where("copies > 1").select("d1", "d2", "rep"))
    standing = made.where("n > 0 AND doc_id IS NOT NULL").join(several, ["d1", "d2"], "left").where("rep IS NULL OR rep = doc_id").select(F.col("doc_id").alias("rep"), "n", "m", "prefix", "bitmap")
    shared_by = staged(shared_tokens(standing.select("rep", F.explode("prefix").alias("token"))), "shared-tokens")
    # shingles of the same members tell the same: one of them stands for all, so long near copies meet a few times and not at every shingle
    groups = staged(shared_by.groupBy("members", "low", "who", "too").agg(F.min("token").alias("token")).select("token", "members"), "prefix-groups")
    met = staged(shared_by.select("rep", "token").join(groups.hint("merge"), "token"), "met-tokens")  # both sides grow with the corpus, so both are shuffled at every size
    # prefixes that no pair asks for go before the join, which may shuffle all profiles
    asked = standing.select("rep", "n", "m", F.when(F.col("m") > 1, F.col("prefix")).alias("prefix"), "bitmap")
    wide = staged(asked.join(met.select("rep").distinct(), "rep", "left_semi"), "met-profiles")
    match = lambda rows: by_groups(rows.join(wide, "rep"), ["token", "x", "y"], _match(percent), "a long, b long")
    clusters = _clusters(match(in_blocks(met, GROUP_ROWS).withColumn("label", F.col("rep"))), "candidates")
    sets = _Sets(docs, k, percent, id_column, text_column)
    labels, parted = sets.joined(clusters)
    links = None  # what joins labels, if anything does
    # what is left: pairs of different labels in groups and clusters that were dealt into blocks
    large = groups.where(F.col("members") > GROUP_ROWS).select("token")
    if parted is not None or large.limit(1).count():
        rest = met.join(large, "token", "left_semi").select("token", "rep")
        if parted is not None:
            rest = rest.unionByName(met.select("token", "rep").join(parted, "rep", "left_semi")).distinct()
        open_rows = staged(rest.join(labels, "rep", "left").select("token", "rep", F.coalesce("label", "rep").alias("label")), "open-tokens")
        again = _clusters(match(across_labels(open_rows, "token", GROUP_ROWS)), "open-candidates")
        links = sets.across(again, labels)
    repeated = staged(made.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("first"), F.max(F.struct("d1", "d2")).alias("last")).where("first <> last").select("doc_id"), "repeated-ids")
    known = made.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2")
    several_texts = repeated.limit(1).count() > 0
    if several_texts:  # the classes of one document's texts belong together
        held = known.where("n_shingles > 0").join(small_side(repeated), "doc_id").select("doc_id", "d1", "d2").distinct().join(classes, ["d1", "d2"]).select("doc_id", "rep")
        held = staged(held, "texts-of-repeated-ids")
        own = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
        links = own if links is None else links.unionByName(own)
    if links is None or links.limit(1).count() == 0:
        linked = labels.select("rep", F.col("label").alias("component_id"))
    else:
        edges = labels.select(F.col("rep").alias("a"), F.col("label").alias("b")).unionByName(links)
        linked = components(edges, "links").select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    named = staged(classes.join(linked, "rep", "left").select("d1", "d2", F.coalesce("component_id", "rep").alias("component_id")), "class-components")
    none = known.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = known.where("n_shingles > 0 AND doc_id IS NOT NULL").join(named, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id").unionByName(none)
    if several_texts:  # a document with an empty text and another one has the component of the other
        own = staged(out.join(small_side(repeated), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("own")), "components-of-repeated-ids")
        out = out.join(small_side(own), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "component_id").alias("component_id"))
    return out


def _clusters(candidates: DataFrame, name: str) -> DataFrame:
    """rep and cluster of the candidates, and how many members its cluster has."""
    nodes = components(candidates, name).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    nodes = staged(nodes, f"{name}-clusters")
    sizes = staged(nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")), f"{name}-sizes")
    return nodes.join(small_side(sizes), "cluster")


class _Sets:
    """The exact comparison of documents' shingle sets, computed from their texts."""

    def __init__(self, docs: DataFrame, k: int, percent: int, id_column: str, text_column: str) -> None:
        self.docs, self.k, self.percent, self.id_column, self.text_column = docs, k, percent, id_column, text_column

    def of(self, rows: DataFrame) -> DataFrame:
        """rep and hashes, the set of each text of the documents whose ids are rows' reps."""
        k = self.k

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, sets in _sets(batches, k):
                for a in range(0, len(sets), 256):
                    part = sets[a : a + 256]
                    yield pa.record_batch({"rep": batch.column(0).slice(a, len(part)), "hashes": pa.array([h.tobytes() for h in part], pa.binary())})

        own = small_side(rows.select(F.col("rep").alias("__cz_rep")))
        texts = self.docs.join(own, F.col(self.id_column).cast("long") == F.col("__cz_rep")).select(F.col("__cz_rep").alias("rep"), F.col(self.text_column).alias("text"))
        return staged(in_arrow(texts, hashes, "rep long, hashes binary"), "sets")

    def compared(self, sets: DataFrame, rows: DataFrame, whole: bool) -> DataFrame:
        """Links among the rows (rep, label, cluster, x, y, side), whose sets are given; with whole, labels that blocks give."""
        return staged(by_groups(sets.join(rows, "rep"), ["cluster", "x", "y"], _verify(self.percent, whole), "a long, b long"), "links")

    def joined(self, clusters: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Labels (rep, label: the smallest rep that links lead to; those of no link have no row) by links within the blocks of
        clusters, and between those members that stand for what links join; and the members of clusters of which more than one label
        is left, if there are any."""
        clusters = staged(clusters, "cluster-members")
        sets = self.of(clusters)
        blocks = lambda rows: small_side(in_blocks(rows.withColumn("label", F.col("rep")), BLOCK_DOCS))
        named = lambda df: df.select(F.col("a").alias("rep"), F.col("b").alias("label"))
        labels = named(self.compared(sets, blocks(clusters), True))
        large = staged(clusters.where(F.col("members") > BLOCK_DOCS).select("rep", "cluster"), "large-clusters")
        before, now, heads, whole = large.count(), 0, None, False
        while before:
            per = large.join(labels, "rep", "left").select("cluster", F.coalesce("label", "rep").alias("label")).distinct()
            per = staged(per, "cluster-labels")
            heads = per.join(per.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "cluster")
            heads = staged(heads.select(F.col("label").alias("rep"), "cluster", "members"), "cluster-heads")
            now = heads.count()
            if whole or now in (0, before):
                break
            whole = not heads.where(F.col("members") > BLOCK_DOCS).limit(1).count()  # all heads of a cluster meet: what is left then has no links
            new = named(self.compared(sets, blocks(heads), True))
            moved = labels.join(small_side(new.select(F.col("rep").alias("label"), F.col("label").alias("next"))), "label", "left")
            labels, before = staged(moved.select("rep", F.coalesce("next", "label").alias("label")).unionByName(new), "labels"), now
        return labels, large.join(heads.select("cluster").distinct(), "cluster", "left_semi").select("rep") if now else None

    def across(self, clusters: DataFrame, labels: DataFrame) -> DataFrame:
        """All links between members of a cluster with different labels."""
        rows = staged(clusters.join(labels, "rep", "left").select("rep", "cluster", F.coalesce("label", "rep").alias("label")), "open-members")
        return self.compared(self.of(rows.select("rep")), across_labels(rows, "cluster", BLOCK_DOCS), False)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Texts without words stay."""
    decided = staged(join(docs, k, percent, id_column, text_column), "near-duplicates")
    gone = staged(decided.where("doc_id <> component_id").select(F.col("doc_id").alias("__cz_gone")).distinct(), "gone")
    return docs.join(small_side(gone), F.col(id_column).cast("long") == F.col("__cz_gone"), "left_anti")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


OP10_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM split
), sizes AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets
), shingles AS (
  SELECT doc_id, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS both_ FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT i, j FROM shared JOIN sizes p ON p.doc_id = i JOIN sizes q ON q.doc_id = j WHERE 100 * both_ >= 90 * (p.n + q.n - both_)
), either AS (
  SELECT i, j FROM links UNION ALL SELECT j, i FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, e.j FROM reach r JOIN either e ON e.i = r.other
)
SELECT s.doc_id, s.n AS n_shingles, m.component_id FROM sizes s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""
