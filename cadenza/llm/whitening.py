"""Whitening of embeddings by the leading eigenvectors of their covariance, found by spectrum slicing.

Vectors become whole numbers x = floor(SCALE * component) + OFFSET. The fit list holds each distinct x once; Spark adds up its sums S (exact) and, in a second
pass, the products of centred vectors, (n * x - S) / n, task by task: a task sends one matrix, the driver gets one of d x d.

Spectrum slicing: the number of negative pivots of an LDLT factorisation of V - s I is the number of eigenvalues below s (Sylvester's law of inertia).
Halving an interval by such counts isolates the k-th largest eigenvalue; Rayleigh quotient iteration from there converges cubically, and counts just
below and just above the quotient certify that it is the k-th. If the iteration leaves the interval, the interval is halved on. Eigenvalues that are not told apart to
double precision form a cluster; its vectors are an orthonormal basis of the cluster's space, by inverse iteration of a block.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are those of another length than the table's
most common one (the larger of equally common ones) and those with an entry of 2^46 or more, whose whole numbers doubles can't hold with room for sums.
Repeated rows are returned each, ids may be null. Components whose eigenvalue is zero to double precision can't be whitened and are not returned: no rows
at all if all vectors are equal. deviation is null where it is no long. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import in_arrow, staged

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
_EPS = np.finfo(float).eps
#: The least element of a Bunch-Kaufman pivot of one row, as a part of the column's largest.
_ALPHA = (1 + 17**0.5) / 8


def inertia_below(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric a are below shift: negative pivots of LDLT of a - shift I, with pivots of one or two rows."""
    a = a - shift * np.eye(len(a))
    n, i, below = len(a), 0, 0
    tiny = _EPS * max(np.abs(a).max(initial=0.0), 1e-300)

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while i < n:
        column = np.abs(a[i + 1 :, i])
        r = i + 1 + int(column.argmax()) if len(column) else i
        largest = column.max(initial=0.0)
        two = False
        if abs(a[i, i]) < _ALPHA * largest:
            other = np.abs(a[i:, r])
            other[r - i] = 0.0
            sigma = other.max()
            if abs(a[i, i]) * sigma >= _ALPHA * largest * largest:
                pass
            elif abs(a[r, r]) >= _ALPHA * sigma:
                swap(i, r)
            else:
                swap(i + 1, r)
                two = True
        if two:  # such a pivot has one eigenvalue of each sign
            block, low = a[i : i + 2, i : i + 2], a[i + 2 :, i : i + 2]
            below += 1
            a[i + 2 :, i + 2 :] -= low @ np.linalg.solve(block, low.T)
            i += 2
        else:
            pivot = a[i, i] if abs(a[i, i]) > tiny else tiny  # on an eigenvalue: not below
            below += pivot < 0
            low = a[i + 1 :, i]
            a[i + 1 :, i + 1 :] -= np.outer(low / pivot, low)
            i += 1
    return int(below)


def _solved(a: np.ndarray, shift: float, b: np.ndarray, scale: float) -> np.ndarray:
    eye = np.eye(len(a))
    for step in range(8):
        try:
            out = np.linalg.solve(a - (shift + step * _EPS * scale) * eye, b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out
    return b


def _free(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """x (a vector or a block) made orthogonal to the rows of others, twice for rounding."""
    for _ in range(2):
        x = x - others.T @ (others @ x)
    return x


def _rayleigh(v: np.ndarray, low: float, high: float, x: np.ndarray, others: np.ndarray, scale: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration for the one eigenvalue between low and high; None if it leaves them or doesn't converge."""
    for _ in range(2):
        x = _free(_solved(v, (low + high) / 2, x, scale), others)
        x = x / np.linalg.norm(x)
    best = None
    for _ in range(12):
        rho = float(x @ v @ x)
        if not low <= rho <= high:
            return None
        rest = float(np.linalg.norm(v @ x - rho * x))
        if best is not None and rest >= best[0]:
            break
        best = (rest, rho, x)
        x = _free(_solved(v, rho, x, scale), others)
        x = x / np.linalg.norm(x)
    return best[1:] if best[0] <= 64 * _EPS * scale else None


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (most at most, zero ones left out) of a covariance, falling, and their unit vectors as rows."""
    d = len(v)
    v = (v + v.T) / 2
    scale = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    if not scale:
        return np.zeros(0), np.zeros((0, d))
    least, apart, near = 4 * d * _EPS * scale, 16 * d * _EPS * scale, 8 * d * _EPS * scale
    counts: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = d - inertia_below(v, s)
        return counts[s]

    start = np.random.default_rng(1).normal(size=(d, d))
    values, vectors = [], np.zeros((0, d))
    top = scale * (1 + 4 * _EPS)
    counts[top] = 0
    want = min(most, above(least))
    while len(values) < want:
        k = len(values)  # more than k eigenvalues are above low, at most k above high
        low, high = max(s for s, c in counts.items() if c > k), min(s for s, c in counts.items() if c <= k)
        found = None
        while high - low > apart and found is None:
            if above(low) - above(high) == 1:
                found = _rayleigh(v, low, high, start[:, k], vectors, scale)
                if found and not above(found[0] - near) > k >= above(found[0] + near):
                    found = None
            if found is None:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) > k else (low, middle)
        if found:
            values.append(found[0])
            vectors = np.vstack([vectors, found[1]])
        else:  # what is not told apart: a cluster
            block = start[:, k : above(low)]
            for _ in range(6):
                block = np.linalg.qr(_free(_solved(v, (low + high) / 2, block, scale), vectors))[0]
            values += [float(x @ v @ x) for x in block.T]
            vectors = np.vstack([vectors, block.T])
    return np.array(values[:want]), vectors[:want]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """vec_id and x of the rows that take part, and their length."""
    v = F.col("v")
    ok = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.forall(v, lambda e: F.abs(e) < 2.0**46)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0)).where(ok)
    most = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 1
    return rows.where(F.size(v) == d).select("vec_id", F.transform(v, lambda e: F.floor(e * SCALE) + OFFSET).alias("x")), d


def _x(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers, or Python's where those don't do."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums)) >= 1 << 62:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def squares(deviation: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row, null where it is no long."""
    about = (deviation.astype(np.float64) ** 2).sum(axis=1)
    if deviation.dtype == object or about.max(initial=0.0) >= 2.0**62:
        exact = [sum(int(e) ** 2 for e in row) for row in deviation]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
    return pa.array((deviation * deviation).sum(axis=1))


def _summed(parts: DataFrame, d: int) -> np.ndarray:
    """The sum of d x d matrices, sent as rows (at, row)."""
    cells = parts.select("at", F.posexplode("row").alias("to", "e")).groupBy("at", "to").agg(F.sum("e").alias("e")).collect()  # d * d rows
    out = np.zeros((d, d))
    for r in cells:
        out[r["at"], r["to"]] = r["e"]
    return out


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row and leading component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, d = usable(vectors, id_column, vector_column)
    fit = staged(rows.select("x").distinct(), "whitening-fit")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                x = _x(batch.column(0), d)
                n += len(x)
                total = [a + sum(int(p) for p in part) for a, part in zip(total, zip(*(x[i : i + 1024].sum(axis=0) for i in range(0, len(x), 1024)), strict=True), strict=True)]
        if n:
            yield pa.record_batch({"at": pa.array(range(d), pa.int32()), "total": pa.array(total, pa.decimal128(38, 0)), "n": pa.array([n] * d, pa.int64())})

    got = in_arrow(fit, add, "at int, total decimal(38,0), n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()  # d rows
    n, sums = (got[0]["n"], [int(r["total"]) for r in got]) if got else (1, [0] * d)

    def products(axes: np.ndarray | None) -> np.ndarray:
        """The covariance of the fit list, or of what its centred vectors are along axes."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = 0.0, False
            for batch in batches:
                if batch.num_rows:
                    centred = deviations(_x(batch.column(0), d), n, sums).astype(np.float64) / n
                    centred = centred if axes is None else centred @ axes
                    total, some = total + centred.T @ centred, True
            if some:
                yield pa.record_batch({"at": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total))})

        return _summed(in_arrow(fit, add, "at int, row array<double>"), d if axes is None else axes.shape[1]) / n

    v = products(None)
    values, axes = leading(v, components)
    spread = (axes / np.sqrt(values)[:, None]).T
    k = len(values)
    error = float(np.abs(products(spread) - np.eye(k)).max()) if k else 0.0
    explained = values / np.trace(v) if k else values

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if k and batch.num_rows:
                deviation = deviations(_x(batch.column(1), d), n, sums)
                m, each = batch.num_rows, np.repeat(np.arange(batch.num_rows), k)
                whitened = deviation.astype(np.float64) / n @ spread
                yield pa.record_batch({
                    "vec_id": batch.column(0).take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, n)), "deviation": squares(deviation).take(pa.array(each)),
                    "whitened": pa.array(whitened.ravel()), "explained": pa.array(np.tile(explained, m)), "identity_error": pa.array(np.full(m * k, error)),
                })

    return in_arrow(rows, out, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
