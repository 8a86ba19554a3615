"""Shared pieces of the training-data operators: staged tables, checked broadcasts, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: A table is broadcast only after its bytes have been added up and are at most this many.
BROADCAST_BYTES = 16 << 20
#: About how many bytes of rows Spark sends to a Python worker at once (in_arrow).
ARROW_BYTES = 1 << 20
#: Tasks of fewer bytes, in and out, do not hand memory back.
LEAN_BYTES = 1 << 17

_test_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session on one machine gets a new
    folder (tests), and a cluster's an error, as its executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _test_dirs:
            _test_dirs[app] = tempfile.mkdtemp(prefix="cadenza-")
            spark.sparkContext.setCheckpointDir(_test_dirs[app])
        base = _test_dirs[app]
    return f"{base.rstrip('/')}/cadenza/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not what came before, and
    what several later steps read is computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Removes what this application has staged. For callers, once the results that hang on it are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda s, x: s + _width(x, kind.elementType))
        else:
            inner = F.size(value).cast("long") * F.lit(8 * max(1, len(getattr(kind.elementType, "fields", [0]))))
        return F.coalesce(inner, F.lit(0)) + F.lit(16)
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows (added up in one pass) take at most that many bytes, else as it is: Spark then shuffles."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    held = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if held <= most else df


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with lean workers and small batches.

    A batch of texts is held by the JVM and by the worker at the same time, several times while it is made, and native
    allocators keep large buffers: so the session's spark.sql.execution.arrow.maxBytesPerBatch is set to ARROW_BYTES.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(lean(work), schema)


def label_sample(rows: DataFrame, label: str, key: str, each: int) -> DataFrame:
    """Of each label the rows (at most each) whose keys hash lowest, and no others.

    The labels are counted first, so that only about 1.5 times that many rows of each meet in a task. Keys are distinct. Callers
    bound the number of labels.
    """
    low = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = F.broadcast(rows.groupBy(label).agg(F.count(F.lit(1)).alias("__cz_rows")))  # a row per label
    near = rows.join(counts, label).where(low <= (1.5 * each + 50) / F.col("__cz_rows"))
    order = W.partitionBy(label).orderBy(low, key)
    return near.withColumn("__cz_n", F.row_number().over(order)).where(F.col("__cz_n") <= each).drop("__cz_n", "__cz_rows")


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of rows rows, whose column holds about limit bytes at most (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        if col.nbytes <= limit and len(col) <= rows:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and (held + n > limit or i - start == rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n) + 1
        yield batch.slice(start)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, which hands its memory back to the system when a task ends: workers live on for later stages. A task of few bytes
    leaves that to later ones, as the collection takes longer than its work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for batch in batches:
                held += batch.nbytes
                yield batch

        for out in work(counted()):
            held += out.nbytes
            yield out
        if held < LEAN_BYTES:
            return
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return run


def by_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies work to the rows of df with all rows of equal keys (whole numbers) together, many groups at a time.

    work gets a table and where its groups begin (one more entry: the end). A task holds one Arrow batch and
    the group that its end cuts, so the caller bounds its groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            table = table if held is None else pa.concat_tables([held, table])
            columns = [table[k].to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            if len(cuts):
                yield work(table.slice(0, cuts[-1]).combine_chunks(), np.concatenate([[0], cuts]))
                table = table.slice(cuts[-1])
            held = table
        if held is not None:
            yield work(held.combine_chunks(), np.array([0, held.num_rows]))

    return in_arrow(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)
