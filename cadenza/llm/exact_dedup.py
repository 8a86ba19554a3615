"""Exact dedup by exchange of Golomb-coded fingerprints.

1. Every task reads its documents once. JVM functions give each a fingerprint (48 bits of xxhash64)
   and the SHA-256 of its text. The task sorts the fingerprints of up to BLOCK_ROWS rows (a block), cuts
   the list at the owners' borders and codes each piece. Text never leaves the JVM.
2. An owner decodes the pieces of its range from all blocks and answers each with a bitmap: bit i is set
   if fingerprint i also occurs elsewhere.
3. A row knows its block, owner and place in the list, so one join with the bitmaps makes it a suspect or not.
   Rows that are not suspects are unique.
4. Only suspects' texts are shuffled. They are grouped by the text itself, which compares bytes;
   equal rows are combined before the shuffle, so a group of copies of any size stays small.

Memory: a task holds one block (BLOCK_ROWS fingerprints), an owner its range of fingerprints: about OWNER_ROWS at most, as
the rows are counted first (a parquet table's footers tell) and the number of owners follows from that.

Defined results: a null text counts as empty, and all such rows are equal; a null doc_id is smaller than any
other; of rows that repeat text and doc_id exactly one stays; an empty table gives an empty result. Columns
whose names begin with __cz_ are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm import golomb
from cadenza.llm.common import in_arrow, small_side, staged, text_of

BITS = 48
BLOCK_ROWS = 1 << 20
#: Fingerprints of an owner at most (they spread evenly); small tables have an owner for every LEAST_ROWS, so that all cores work.
OWNER_ROWS = 1 << 21
LEAST_ROWS = 1 << 15
_SENT = "doc_id long, fp long, sha string, block string, row int, owner int, pos int, n int, k int, code binary"


def fingerprint(text: str, bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text_of(text)), 64 - bits)


def _send(owners: int, bits: int):
    """Rows (their place in the list added) and, for each owner, the coded piece of each block."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def block() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            fps = table["fp"].to_numpy()
            values, place = np.unique(fps, return_inverse=True)
            counts = np.bincount(place)
            owner = (values >> (bits - 24)) * owners >> 24
            first = np.searchsorted(owner, np.arange(owners + 1))
            n, name = table.num_rows, f"{part}-{number}"
            own = owner[place].astype(np.int32)
            empty = {"n": pa.nulls(n, pa.int32()), "k": pa.nulls(n, pa.int32()), "code": pa.nulls(n, pa.binary())}
            columns = {"doc_id": table["doc_id"], "fp": table["fp"], "sha": table["sha"], "block": pa.array([name] * n), "row": pa.array(np.arange(n, dtype=np.int32)), "owner": pa.array(own), "pos": pa.array((place - first[own]).astype(np.int32)), **empty}
            yield from pa.table(columns).to_batches(max_chunksize=1 << 16)
            sent = [(o, first[o], first[o + 1]) for o in range(owners) if first[o] < first[o + 1]]
            # a code is followed by a bitmap of the values that occur twice within the block
            coded = [(golomb.encode(values[a:b]), np.packbits(counts[a:b] > 1).tobytes()) for _, a, b in sent]
            m = len(sent)
            yield pa.record_batch(
                {
                    "doc_id": pa.nulls(m, pa.int64()), "fp": pa.nulls(m, pa.int64()), "sha": pa.nulls(m, pa.string()), "block": pa.array([name] * m, pa.string()), "row": pa.nulls(m, pa.int32()), "owner": pa.array([x[0] for x in sent], pa.int32()),
                    "pos": pa.nulls(m, pa.int32()), "n": pa.array([int(b - a) for _, a, b in sent], pa.int32()), "k": pa.array([c[0][0] for c in coded], pa.int32()), "code": pa.array([c[1] + c[0][1] for c in coded], pa.binary()),
                }
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from block()
                number, held, rows = number + 1, [], 0
        if rows:
            yield from block()

    return send


def _answer(pieces: pd.DataFrame) -> pd.DataFrame:
    """The owner's part: for each piece a bitmap of its values that occur elsewhere, or twice in their block."""
    lists, twice = [], []
    for n, k, code in zip(pieces["n"], pieces["k"], pieces["code"], strict=True):
        head = (n + 7) // 8
        twice.append(np.unpackbits(np.frombuffer(code[:head], dtype=np.uint8))[:n])
        lists.append(golomb.decode(k, n, code[head:]))
    values, place, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    marked = (counts[place] > 1) | (np.concatenate(twice) > 0)
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    out = pieces[["block", "owner"]].assign(bitmap=[np.packbits(x).tobytes() for x in np.split(marked, cuts)])
    return out[[bool(x.any()) for x in np.split(marked, cuts)]]


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS, owners: int | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 and fp, the fingerprint."""
    spark = docs.sparkSession
    if owners is None:
        n = docs.count()
        owners = max(1, -(-n // OWNER_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS)))
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), fingerprint(text_column, bits).alias("fp"), F.sha2(text_of(text_column), 256).alias("sha"))
    sent = staged(in_arrow(narrow, _send(owners, bits), _SENT), "fingerprints")
    rows = sent.where("n IS NULL").select("doc_id", "fp", "sha", "block", "row", "owner", "pos")
    pieces = sent.where("n IS NOT NULL").select("block", "owner", "n", "k", "code")
    bitmaps = staged(pieces.groupBy("owner").applyInPandas(_answer, "block string, owner int, bitmap binary"), "bitmaps")
    byte = F.conv(F.hex(F.expr("substring(bitmap, pos div 8 + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("7 - pos % 8")
    suspect = F.coalesce(F.getbit(byte, bit) == 1, F.lit(False))
    flagged = staged(rows.join(small_side(bitmaps), ["block", "owner"], "left").select("doc_id", "fp", "sha", suspect.alias("suspect"), F.concat("block", F.lit(":"), "row").alias("at")), "suspects")
    wanted = staged(flagged.where("suspect").select(F.col("fp").alias("__cz_fp")).distinct(), "suspect-fingerprints")
    texts = docs.select(F.col(id_column).cast("long").alias("__cz_id"), text_of(text_column).alias("__cz_text")).withColumn("__cz_fp", fingerprint("__cz_text", bits))
    verified = (
        texts.join(small_side(wanted), "__cz_fp", "left_semi")
        .groupBy("__cz_fp", "__cz_text")
        .agg(F.max("__cz_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.col("__cz_fp").alias("fp"), F.sha2("__cz_text", 256).alias("sha"), "keep_id", "group_size")
    )
    groups = staged(verified, "copy-groups")
    # of rows that repeat text and doc_id the one at the first place stays; partial sums find it, so there may be any number
    same = flagged.where("suspect").groupBy("fp", "sha", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.min("at").alias("r_at"))
    copies = flagged.where("suspect").join(small_side(groups), ["fp", "sha"]).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    few = small_side(staged(same.where("times > 1"), "repeated-rows").select(F.col("fp").alias("r_fp"), F.col("sha").alias("r_sha"), F.col("doc_id").alias("r_id"), "r_at"))
    match = (F.col("fp") == F.col("r_fp")) & (F.col("sha") == F.col("r_sha")) & F.col("doc_id").eqNullSafe(F.col("r_id"))
    copies = copies.join(few, match, "left").withColumn("kept", F.col("kept") & (F.col("r_at").isNull() | (F.col("r_at") == F.col("at"))))
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), "fp"]
    return (
        flagged.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "fp")
        .unionByName(copies.select(*out))
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows that go. Of rows that repeat text and doc_id one stays: that whose columns together hash lowest."""
    decided = staged(dedup(docs, id_column, text_column), "dedup")
    marked = docs.withColumn("__cz_sha", F.sha2(text_of(text_column), 256))
    gone = decided.where("NOT kept").select(F.col("doc_id").alias("__cz_id"), F.col("text_sha256").alias("__cz_gone"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__cz_again")).distinct()
    met = marked.join(small_side(staged(gone, "gone")), F.col(id_column).cast("long").eqNullSafe(F.col("__cz_id")) & (F.col("__cz_sha") == F.col("__cz_gone")), "left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = met.where("__cz_again").groupBy("__cz_sha", "__cz_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__cz_row"))
    return met.where("__cz_gone IS NULL").select(*docs.columns).unionByName(one.select("__cz_row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""
