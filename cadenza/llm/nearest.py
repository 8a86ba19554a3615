"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

Index (all rows): vectors are brought to length 1, their mean is taken off, and a random rotation (seeded) is applied.
Of a rotated residual r only the signs are kept, as packed bits, with two numbers: its length, and how
far r lies along its own sign vector. For a query residual q the packed signs give an unbiased estimate of
<r, q>, and its error stays below an expression in these numbers but for rare cases (ERROR_SPREAD standard deviations).
So each row has an upper bound on its cosine; rows whose bound beats the nearest ones found so far are
reranked by their original vectors in double precision.

Equal vectors become one class first: of a class only the smallest ids can be among the nearest, so only
those are carried (nearest + 1, as a query leaves itself out). Queries and classes are dealt into blocks, and every block of
queries meets every block of classes in a group of its own; a group sends on the nearest of each query. A block of
one side is sent once for each block of the other, so blocks are as large as a task can hold.

Memory: a task holds at most QUERY_BLOCK queries, CLASS_BLOCK classes (of BLOCK_BYTES of doubles each) and a strip of their estimates.

Lengths and products are taken of vectors whose largest component was brought near 1 by a power of two: that changes no
cosine, and vectors of any finite size neither overflow nor vanish.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of
another length than the table's most common one (the larger of equally common ones; it holds for the queries too), nor rows without id; if there are fewer
candidates all are returned; rows that repeat a vec_id are candidates of their own, except that none with the query's own
id is returned for it; a repeated query id is searched once, with its first vector in order. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cadenza.llm.common import in_arrow, staged

NEAREST = 5
QUERY_BLOCK = 16_384
CLASS_BLOCK = 16_384
BLOCK_BYTES = 16 << 20
#: Classes are dealt into as many blocks as there are shuffle partitions, but not into smaller ones than this.
_LEAST_BLOCK = 2048
ERROR_SPREAD = 2.4
_STRIP = 64


def rotation(dimensions: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 0.5 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of length 1: packed signs, residual length, residual times centre, and the cosine of residual and signs."""
    residual = unit(x) - centre
    rotated = residual @ turn
    length = np.linalg.norm(rotated, axis=1)
    along = np.abs(rotated).sum(axis=1) / np.sqrt(x.shape[1]) / np.maximum(length, 1e-300)
    return np.packbits(rotated > 0, axis=1), length, residual @ centre, along


def estimates(codes: np.ndarray, length: np.ndarray, offset: np.ndarray, along: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries (rows of length 1) and coded rows, and the bounds of their errors.

    With residuals r = x - c and s = q - c the cosine is <r, s> + <r, c> + <c, q>; only <r, s> is estimated.
    """
    return _estimates(sign_rows(codes, turn.shape[0]), length, offset, along, queries, centre, turn)


def sign_rows(codes: np.ndarray, d: int) -> np.ndarray:
    """The packed signs as rows of length 1."""
    return (np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))


def _estimates(signs: np.ndarray, length: np.ndarray, offset: np.ndarray, along: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = turn.shape[0]
    residual = queries - centre
    rotated = (residual @ turn).astype(np.float32)
    scale = length / np.maximum(along, 1e-12)
    near = rotated @ signs.T * scale.astype(np.float32) + (offset + 0.0).astype(np.float32) + (queries @ centre).astype(np.float32)[:, None]
    spread = length * np.sqrt(np.maximum(0.0, 1 - along**2)) / np.maximum(along, 1e-12) / np.sqrt(max(1, d - 1))
    return near, (ERROR_SPREAD * spread).astype(np.float32) * np.linalg.norm(residual, axis=1).astype(np.float32)[:, None]


def _vectors(col: pa.Array, dimensions: int) -> np.ndarray:
    values = col.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def usable(vectors: DataFrame, id_column: str, vector_column: str, d: int | None = None) -> tuple[DataFrame, int]:
    """vec_id and v of the rows that take part, and their length: d, or else the most common one. Floats stay floats."""
    kind = "float" if isinstance(vectors.schema[vector_column].dataType, T.ArrayType) and isinstance(vectors.schema[vector_column].dataType.elementType, T.FloatType) else "double"
    ok = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(f"array<{kind}>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(ok)
    if d is None:
        most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        d = most[0]["d"] if most else 1
    return rows.where(F.size("v") == d), d


def nearest(vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", nearest: int = NEAREST, seed: int = 7) -> DataFrame:
    """For each query row its nearest rows of vectors other than itself: query_id, rank, vec_id, score."""
    rows, d = usable(vectors, id_column, vector_column)
    turn = rotation(d, seed)
    members = W.partitionBy("v").orderBy("vec_id")
    # Spark keeps the first of each class before it shuffles, so a class of any size stays small
    kept = rows.withColumn("place", F.row_number().over(members)).where(F.col("place") <= nearest + 1)
    classes = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d), 0
        for batch in batches:
            if batch.num_rows:
                total += unit(_vectors(batch.column(0), d)).sum(axis=0)
                n += batch.num_rows
        if n:
            yield pa.record_batch({"at": pa.array(range(d), pa.int32()), "total": pa.array(total), "n": pa.array([n] * d, pa.int64())})

    sums = in_arrow(rows.select("v"), add, "at int, total double, n long").groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("at").collect()  # d rows
    centre = np.array([r["mean"] for r in sums]) if sums else np.zeros(d)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits, length, offset, along = encode(_vectors(batch.column(0), d), centre, turn)
                yield pa.record_batch({"v": batch.column(0), "ids": batch.column(1), "code": pa.array([b.tobytes() for b in bits], pa.binary()), "length": pa.array(length), "offset": pa.array(offset), "along": pa.array(along)})

    kind = rows.schema["v"].dataType.simpleString()
    index = staged(in_arrow(classes, code, f"v {kind}, ids array<long>, code binary, length double, offset double, along double"), "vector-index")
    # of a repeated id the first vector in order; partial sums keep one of them, so an id may be repeated at will
    asked = usable(queries, id_column, vector_column, d)[0].groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = staged(asked.withColumnRenamed("vec_id", "query_id"), "queries")
    held = max(1, BLOCK_BYTES // (8 * d))
    n, spread = index.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    class_blocks = max(1, -(-n // min(CLASS_BLOCK, held)), min(spread, -(-n // _LEAST_BLOCK)))
    query_blocks = max(1, -(-asked.count() // min(QUERY_BLOCK, held)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("c", every(class_blocks))
    right = index.withColumn("c", F.pmod(F.xxhash64("code", "length"), F.lit(class_blocks)).cast("int")).withColumn("q", every(query_blocks))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        names, vq = a["query_id"].to_numpy(), _vectors(a["v"].chunk(0), d)
        vb, ids = _vectors(b["v"].chunk(0), d), b["ids"].chunk(0)
        codes = np.frombuffer(b"".join(b["code"].to_pylist()), dtype=np.uint8).reshape(len(vb), -1)
        length, offset, along = (b[c].to_numpy() for c in ("length", "offset", "along"))
        unit_q, scaled_b, signs = unit(vq), scaled(vb), sign_rows(codes, d)
        vq, norm_q, norm_b = scaled(vq), np.linalg.norm(scaled(vq), axis=1), np.linalg.norm(scaled_b, axis=1)
        cosine = lambda q, x: np.einsum("ij,ij->i", vq[q], scaled_b[x]) / (norm_q[q] * norm_b[x])
        want = nearest + 1  # a query's own class may be among them
        out_q, out_x, out_s = [], [], []
        for s in range(0, len(vq), _STRIP):
            q = np.arange(s, min(len(vq), s + _STRIP))
            near, error = _estimates(signs, length, offset, along, unit_q[q], centre, turn)
            if len(vb) > 4 * want:
                # the exact cosines of the likeliest rows give the bar that the others' bounds must reach
                first = np.argpartition(-near, 4 * want - 1, axis=1)[:, : 4 * want]
                exact = cosine(np.repeat(q, 4 * want), first.ravel()).reshape(first.shape)
                bar = -np.partition(-exact, want - 1, axis=1)[:, want - 1]
                qi, x = np.nonzero(near + error >= bar[:, None] - 1e-6)
                qi, x = np.concatenate([qi, np.repeat(np.arange(len(q)), 4 * want)]), np.concatenate([x, first.ravel()])
                pairs = np.unique(qi * len(vb) + x)
                qi, x = pairs // len(vb), pairs % len(vb)
            else:
                qi, x = (v.ravel() for v in np.indices((len(q), len(vb))))
            score = cosine(q[qi], x)
            order = np.lexsort((-score, qi))
            qi, x, score = qi[order], x[order], score[order]
            ends = np.searchsorted(qi, np.arange(len(q) + 1))
            rank = np.arange(len(qi)) - ends[qi]
            worst = score[np.minimum(ends[qi] + want - 1, ends[qi + 1] - 1)]
            keep = (rank < want) | (score >= worst)  # and what ties with the last
            out_q.append(q[qi[keep]])
            out_x.append(x[keep])
            out_s.append(score[keep])
        oq, ox, os = np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
        flat = ids.take(pa.array(ox)).flatten().to_numpy()
        n = sizes[ox]
        return pa.table({"query_id": np.repeat(names[oq], n), "vec_id": flat, "score": np.repeat(os, n)})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id <> query_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
