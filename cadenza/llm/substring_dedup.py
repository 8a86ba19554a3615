"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: h(i) = 2 h(i-1) + gear[byte i], of which only the last 32 bytes count. Where
its (mixed) value is the least within RADIUS bytes on either side, a chunk ends. The rule looks at nothing but nearby
bytes, so a passage that occurs in two texts is cut alike in both (but for its edges), whatever stands before it. (Of what recurs
within RADIUS bytes only the first place counts, so a short phrase said over and over makes one long chunk.) Chunks are
longer than RADIUS bytes, and in long runs without such a place they are cut every MOST bytes.

Chunks are compared by 128-bit digests. Spark counts digests with partial sums, so a passage in any number of documents
costs one row per task. Chunks that occur at several places and stand side by side make up a run, and runs of at least
MIN_BYTES bytes are repeats. Of each chunk the first place stays: the least start in the document with the smallest id, which
keeps it; so a run falls into spans by keeper. A document also keeps what is not its own for less than MIN_BYTES bytes on end: a
short passage shared with another document takes nothing out of it. What is cut is thus always held whole, chunk by chunk, by its
keepers. With within, what a document repeats of itself is a repeat too, of which the first place stays; without, only what lies in
two documents or more.

Defined results: a null text is empty and has no chunks; rows that repeat doc_id and text count as one document, rows that repeat a doc_id with
another text as another document (text_key, a hash of the text, tells them apart), so no text is cut for another one's spans; a row without
doc_id is never a repeat; an empty table gives an empty result. A task holds one Arrow batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import in_arrow, small_side, staged, sub_batches
from cadenza.llm.textbytes import column_bytes

RADIUS = 24
MOST = 1024
MIN_BYTES = 112
_GEAR = np.random.default_rng(90210).integers(0, 1 << 32, 256, dtype=np.uint32)
_EDGE = np.iinfo(np.uint32).max


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, by doubling the window: the sum over 2w bytes is that over w, twice."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8, 16):
        shifted = h[:-w] << np.uint32(w)
        h = h.copy()
        h[w:] += shifted
    return h * np.uint32(0x9E3779B1)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where the chunks of a text end, in bytes; the last is its length."""
    n = len(data)
    if n <= RADIUS:
        return np.array([n] if n else [], dtype=np.int64)
    h = gear_hash(data)
    padded = np.full(n + 2 * RADIUS, _EDGE, dtype=np.uint32)
    padded[RADIUS:-RADIUS] = h
    least, w = padded, 1
    while 2 * w <= 2 * RADIUS + 1:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    least = np.minimum(least[: n], least[2 * RADIUS + 1 - w :][:n])
    at = np.flatnonzero(h == least)
    at = at[np.concatenate([[True], np.diff(at) > RADIUS])] if len(at) else at  # of equal values side by side the first
    ends = np.unique(np.concatenate([at + 1, [n]]))
    gaps = np.diff(ends, prepend=0)
    if (gaps > MOST).any():
        more = [np.arange(e - g + MOST, e, MOST) for e, g in zip(ends, gaps, strict=True) if g > MOST]
        ends = np.unique(np.concatenate([ends, *more]))
    for _ in range(3):  # not within a character
        inside = ends < n
        inside[inside] = (data[ends[inside]] & 0xC0) == 0x80
        ends = ends + inside
    return np.unique(ends)


_CHUNKS = "doc_id long, text_key long, start int, stop int, d1 long, d2 long"


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in sub_batches(batches, "text"):
        data, at = column_bytes(batch.column(2))
        names, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        starts, stops, digests, counts = [], [], [], []
        for i in range(len(names)):
            text = data[at[i] : at[i + 1]]
            ends = chunk_ends(text)
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            raw = text.tobytes()
            digests += [digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            starts.append(begins)
            stops.append(ends)
            counts.append(len(ends))
        halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        yield pa.record_batch(
            {"doc_id": pa.array(np.repeat(names, counts)), "text_key": pa.array(np.repeat(keys, counts)), "start": pa.array(np.concatenate(starts).astype(np.int32)), "stop": pa.array(np.concatenate(stops).astype(np.int32)), "d1": pa.array(halves[:, 0].copy()), "d2": pa.array(halves[:, 1].copy())}
        )


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_bytes: int = MIN_BYTES, within: bool = True) -> DataFrame:
    """A row for each repeated span: doc_id, text_key, start and n_bytes (in UTF-8), keep_id (the smallest id that holds it, or doc_id itself
    if the span stays), kept (whether it stays), and copies, how often its most frequent chunk occurs. Spans of a run stand side by
    side and may each be shorter than min_bytes."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    chunks = staged(in_arrow(rows, _chunk, _CHUNKS), "chunks")
    place = F.struct("doc_id", "text_key", "start")
    seen = chunks.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("copies"))
    several = F.col("first") != F.col("last") if within else F.struct("first.doc_id", "first.text_key") != F.struct("last.doc_id", "last.text_key")
    shared = staged(seen.where(several).select("d1", "d2", F.col("first.doc_id").alias("keep_id"), F.col("first.text_key").alias("keep_key"), F.col("first.start").alias("keep_start"), "copies"), "shared-chunks")
    stays = (F.col("doc_id") == F.col("keep_id")) & (F.col("text_key") == F.col("keep_key")) & ((F.col("start") == F.col("keep_start")) | F.lit(not within))
    hits = chunks.join(shared, ["d1", "d2"]).withColumn("kept", stays)  # shared chunks grow with the corpus, so both sides are shuffled
    by_place = W.partitionBy("doc_id", "text_key").orderBy("start", "stop", "keep_id", "kept")
    reach = F.max("stop").over(by_place.rowsBetween(W.unboundedPreceding, -1))
    marked = hits.withColumns({"apart": F.coalesce(reach, F.lit(-1)) < F.col("start"), "before": F.lag("keep_id").over(by_place), "stayed": F.lag("kept").over(by_place)})
    turns = F.col("stayed") != F.col("kept")
    opens = {"run": F.col("apart"), "part": F.col("apart") | turns, "piece": F.col("apart") | turns | (F.col("before") != F.col("keep_id"))}
    pieces = (
        marked.select("doc_id", "text_key", "start", "stop", "keep_id", "kept", "copies", *[F.sum(v.cast("int")).over(by_place).alias(k) for k, v in opens.items()])
        .groupBy("doc_id", "text_key", "run", "part", "piece")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("keep_id").alias("keep_id"), F.min("kept").alias("kept"), F.max("copies").alias("copies"))
    )
    bytes_in = lambda k: F.max("stop").over(W.partitionBy("doc_id", "text_key", k)) - F.min("start").over(W.partitionBy("doc_id", "text_key", k))
    held = pieces.withColumns({"run_bytes": bytes_in("run"), "part_bytes": bytes_in("part")}).where(F.col("run_bytes") >= min_bytes)
    own = F.col("kept") | (F.col("part_bytes") < min_bytes)
    held = held.withColumns({"kept": own, "keep_id": F.when(own, F.col("doc_id")).otherwise(F.col("keep_id"))})
    in_run = W.partitionBy("doc_id", "text_key", "run").orderBy("piece")
    fresh = F.coalesce((F.lag("keep_id").over(in_run) != F.col("keep_id")) | (F.lag("kept").over(in_run) != F.col("kept")), F.lit(True))
    spans = held.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(in_run)).groupBy("doc_id", "text_key", "run", "span")
    return (
        spans.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("keep_id").alias("keep_id"), F.min("kept").alias("kept"), F.max("copies").alias("copies"))
        .withColumn("n_bytes", F.col("stop") - F.col("start"))
        .select("doc_id", "text_key", "start", "n_bytes", "keep_id", "kept", "copies")
    )


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_bytes: int = MIN_BYTES, within: bool = True) -> DataFrame:
    """docs with the repeated spans taken out of every text but for the places that stay."""
    gone = repeats(docs, id_column, text_column, min_bytes, within).where("NOT kept")
    spans = staged(gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "n_bytes"))).alias("__cz_spans")).withColumnsRenamed({"doc_id": "__cz_id", "text_key": "__cz_key"}), "repeated-spans")
    places = F.concat(F.col("__cz_spans"), F.array(F.struct(F.octet_length(text_column).alias("start"), F.lit(0).alias("n_bytes"))))
    cut = F.aggregate(
        places,
        F.struct(F.lit(0).alias("at"), F.lit("").cast("binary").alias("kept")),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["start"] + s["n_bytes"]).alias("at"), F.concat(acc["kept"], F.substring(F.col(text_column).cast("binary"), acc["at"] + 1, s["start"] - acc["at"])).alias("kept")),
        lambda acc: F.decode(acc["kept"], "UTF-8"),
    )
    met = docs.join(small_side(spans), (F.col(id_column).cast("long") == F.col("__cz_id")) & (F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))) == F.col("__cz_key")), "left")
    return met.withColumn(text_column, F.when(F.col("__cz_spans").isNull(), F.col(text_column)).otherwise(cut)).select(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
