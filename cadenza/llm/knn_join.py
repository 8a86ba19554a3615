"""Exact top-k by integer inner product as a Voronoi join of queries and rows.

Vectors become whole numbers: floor(SCALE * component). Pivots (a bounded sample of rows) part the space into cells; every row goes to the cell of its
nearest pivot and carries its distance r to it. Summaries then tell which rows a group of queries may need:

- a query's products with the pivots are known, and pivots are rows: the k-th largest of them (its own id left out) is a score that its k-th best reaches;
- a row x of cell j has <q, x> = <q, p_j> + <q, x - p_j> <= <q, p_j> + |q| r, so x is needed by a group of queries only if the
  largest <q, p_j> of the group plus its largest |q| times r reaches the least of its queries' known scores.

Queries of neighbouring cells (a walk from pivot to nearest pivot) form groups of about QUERY_GROUP rows, and a cell with more is dealt to several groups. Rows are
dealt the same way into blocks of ROW_BLOCK. A row is sent to the groups that need it and to no other, and a task compares one group with one block:
products in double precision, which are exact as long as lengths allow it (below 2^53), and in 64-bit integers beyond. A block sends on each query's k best.
Where nothing can be ruled out (vectors spread evenly in many dimensions), each row is sent once for each group of queries.

Memory: a task holds a group, a block and a strip of products; the driver holds the pivots (PIVOT_BYTES at most) and numbers by cell.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do those whose squared length is no long (2^63 and
more: their scores would not be longs), those of another length than the table's most common one (the larger of equally common ones; it holds for the
queries too), and rows without id. Zero vectors take part. With fewer candidates all are returned. Rows that repeat an id are candidates of their own, but none with the query's
id is; a repeated query id is searched once, with its first vector in order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cadenza.llm.common import by_groups, in_arrow, small_side, staged

NEAREST = 5
SCALE = 256
QUERY_GROUP = 8192
ROW_BLOCK = 16_384
_LEAST_BLOCK = 2048
#: Rows of a cell, on average, as long as that takes no more than PIVOT_BYTES of pivots.
ROWS_A_CELL = 256
PIVOT_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
_STRIP = 128
#: Part of a bound by which it is raised, for rounding.
_SLACK = 1e-9


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * component) as doubles, which hold each of these exactly."""
    return np.floor(SCALE * values.astype(np.float64))


def usable(vectors: DataFrame, id_column: str, vector_column: str, d: int | None = None) -> tuple[DataFrame, int]:
    """vec_id and v of the rows that take part, and their length: d, or else the most common one. Floats stay floats."""
    element = getattr(vectors.schema[vector_column].dataType, "elementType", None)
    kind = "float" if isinstance(element, T.FloatType) else "double"
    ok = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    size = F.aggregate("v", F.lit(0.0), lambda s, e: s + F.pow(F.floor(e.cast("double") * SCALE).cast("double"), F.lit(2.0)))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(f"array<{kind}>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(ok).where(F.forall("v", lambda e: F.abs(e) < 2.0**24)).where(size < 2.0**63 * (1 - 1e-12))
    if d is None:
        most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        d = most[0]["d"] if most else 1
    return rows.where(F.size("v") == d), d


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return whole(col.flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest pivot and a distance that is not below the true one."""
    cell = np.argmin((pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T), axis=1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1) * (1 + _SLACK)


def chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots in the order of a walk that goes on to the nearest one not yet seen."""
    left = np.ones(len(pivots), bool)
    out = [0] if len(pivots) else []
    while len(out) < len(pivots):
        left[out[-1]] = False
        far = ((pivots - pivots[out[-1]]) ** 2).sum(axis=1)
        out.append(int(np.where(left, far, np.inf).argmin()))
    return np.array(out, int)


def dealt(sizes: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Parts of cells in this order, of about most rows together: each cell's first part, how many parts it is dealt to, and their number.

    A cell with more than most rows gets parts of its own."""
    first, many, part, held = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, 0
    for c in order:
        n = int(sizes[c])
        if held and held + n > most:
            part, held = part + 1, 0
        first[c] = part
        if n > most:
            many[c] = -(-n // most)
            part, held = part + int(many[c]), 0
        else:
            held += n
    return first, many, part + 1


def _part(first: np.ndarray, many: np.ndarray, _: int) -> Column:
    """The part of a row, by its cell and a hash of its id."""
    at = lambda values: F.expr(f"element_at(array({', '.join(str(int(v)) for v in values)}), cell + 1)")
    return (at(first) + F.pmod(F.xxhash64("vec_id"), at(many))).cast("int")


def best_products(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k largest products with rows of other ids, ties to smaller ids: numbers of queries, of rows, products. Rows are in the order of their ids."""
    reach = np.linalg.norm(queries, axis=1).max(initial=0) * np.linalg.norm(rows, axis=1).max(initial=0)
    exact = reach < 2.0**52  # no partial sum rounds
    if not exact:
        queries, rows = queries.astype(np.int64), rows.astype(np.int64)
    out_q, out_x, out_s = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, np.int64)]
    for s in range(0, len(queries), _STRIP):
        names = query_ids[s : s + _STRIP, None]
        score = queries[s : s + _STRIP] @ rows.T
        low = -np.inf if exact else np.iinfo(np.int64).min
        own = names == row_ids[None, :]
        score[own] = low
        want = min(k, len(rows))
        bar = np.partition(score, len(rows) - want, axis=1)[:, len(rows) - want]
        q, x = np.nonzero((score >= bar[:, None]) & ~own)
        found = score[q, x]
        order = np.lexsort((x, -found, q))
        q, x, found = q[order], x[order], found[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        out_q.append(q[keep] + s)
        out_x.append(x[keep])
        out_s.append(found[keep].astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)


def top_products(vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = NEAREST) -> DataFrame:
    """For each query row its k rows of largest integer inner product other than itself: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows, d = usable(vectors, id_column, vector_column)
    kind = rows.schema["v"].dataType.simpleString()
    n = rows.count()
    most = max(1, min(-(-n // ROWS_A_CELL), PIVOT_BYTES // (8 * d)))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).collect()  # a bounded sample
    pivots = whole(np.array([r["v"] for r in drawn], np.float64)).reshape(-1, d) if drawn else np.zeros((1, d))
    pivot_ids = np.array([r["vec_id"] for r in drawn], np.int64)
    longest = float(np.linalg.norm(pivots, axis=1).max())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, r = nearest_pivots(_matrix(batch.column(1), d), pivots)
                yield pa.record_batch({"vec_id": batch.column(0), "v": batch.column(1), "cell": pa.array(cell, pa.int32()), "r": pa.array(r)})

    def summary(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """For each group and cell what the group's queries have in common."""
        parts = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            x, ids = _matrix(table["v"].slice(a, b - a).combine_chunks(), d), table["vec_id"].slice(a, b - a).to_numpy()
            near = x @ pivots.T
            others = np.where(ids[:, None] == pivot_ids[None, :], -np.inf, near) if len(pivot_ids) else near[:, :0]
            known = np.partition(others, -k, axis=1)[:, -k].min() if others.shape[1] >= k else -np.inf
            length = np.linalg.norm(x, axis=1).max()
            slack = _SLACK * (length * longest + 1)
            parts.append((table["g"][a].as_py(), known - slack, length * (1 + _SLACK), near.max(axis=0) + slack))
        m = len(pivots)
        repeated = lambda i: np.repeat([p[i] for p in parts], m)
        columns = {"g": repeated(0).astype(np.int32), "cell": np.tile(np.arange(m, dtype=np.int32), len(parts)), "known": repeated(1), "length": repeated(2), "near": np.concatenate([p[3] for p in parts])}
        return pa.record_batch({name: pa.array(c) for name, c in columns.items()})

    schema = f"vec_id long, v {kind}, cell int, r double"
    index = staged(in_arrow(rows, place, schema), "knn-rows")
    # of a repeated id the first vector in order; partial sums keep one of them, so an id may be repeated at will
    asked = usable(queries, id_column, vector_column, d)[0].groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = staged(in_arrow(asked, place, schema), "knn-queries")
    order = chain(pivots)

    def sizes(df: DataFrame) -> np.ndarray:
        out = np.zeros(len(pivots), int)
        for r in df.groupBy("cell").count().collect():  # a row per cell
            out[r["cell"]] = r["count"]
        return out

    held = max(1, BLOCK_BYTES // (8 * d))
    spread = max(_LEAST_BLOCK, -(-n // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = asked.withColumn("g", _part(*dealt(sizes(asked), order, min(QUERY_GROUP, held))))
    index = index.withColumn("b", _part(*dealt(sizes(index), order, min(ROW_BLOCK, held, spread))))
    bounds = small_side(staged(by_groups(asked.select("g", "vec_id", "v"), ["g"], summary, "g int, cell int, known double, length double, near double"), "knn-bounds"))
    needed = F.col("near") + F.col("length") * F.col("r") >= F.col("known")
    sent = index.join(bounds, "cell").where(needed).select("g", "b", "vec_id", "v")
    # a block is met by a group if its farthest rows are
    met = index.groupBy("cell", "b").agg(F.max("r").alias("r")).join(bounds, "cell").where(needed).select("g", "b").distinct()
    sought = asked.join(small_side(staged(met, "knn-blocks")), "g").select("g", "b", F.col("vec_id").alias("query_id"), "v")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.sort_by("vec_id").combine_chunks()
        names, ids = a["query_id"].to_numpy(), b["vec_id"].to_numpy()
        if not len(names) or not len(ids):
            q, x, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
        else:
            q, x, s = best_products(_matrix(a["v"].chunk(0), d), names, _matrix(b["v"].chunk(0), d), ids, k)
        return pa.table({"query_id": names[q], "vec_id": ids[x], "score": s})

    found = sought.groupBy("g", "b").cogroup(sent.groupBy("g", "b")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(rows, rows.where("vec_id % 50 = 0"))


OP11_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score
  FROM whole q JOIN whole r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
