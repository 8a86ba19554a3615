"""What the rounds of every search share: the columns of a trial, rates, rating against targets, lineage cut between rounds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources import commitlog

Measure = Callable[[DataFrame], DataFrame]
SEQ = ("stage", "seq")
TRIAL = ["segment_hash", "encoder", "crf", "aq_mode", "aq_strength", "vmaf", "out_bytes", "ref_bytes", *SEQ]
#: Recorded trials for each part that rows are dealt into, at most; and the session's setting that holds the number of parts.
PART_TRIALS, PARTS = 500_000, "spark.cadenza.segmentParts"
AS_SORTED = "spark.sql.execution.replaceHashWithSortAgg"


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder of spark.checkpoint.dir. Where that is unset a session on one machine gets a new folder (tests), and a
    cluster's an error."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cadenza-"))


def spread(trials: DataFrame) -> None:
    """Makes the parts of what is dealt out from now on as many as the recorded trials need, so that a part is sorted in memory however many there are."""
    trials.sparkSession.conf.set(PARTS, str(-(-trials.count() // PART_TRIALS)))


def parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(PARTS, "1")))


def dealt(df: DataFrame, n: int | None = None) -> DataFrame:
    """df by segment, in a fixed number of partitions (n, or else parts), so that all that goes on by segment in one plan (windows, groups, joins on the segment and
    more) stays where it lies. Joins on more columns than the segment need the session's leave for that, and so do groups of what a window has sorted
    already, which are then gathered as they lie (else hashed, and sorted once more). kept carries it over to later plans."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set(AS_SORTED, "true")
    return df.repartition(n or parts(spark), "segment_hash")


def kept(df: DataFrame, n: int | None = None) -> DataFrame:
    """df (which has segment_hash) as a compressed table in the shared folder, in as many buckets of segments (n, or else) as dealt makes parts. Later rounds
    join, group and rank its rows where they lie: they shuffle nothing. A union's rows would be dealt out again, so unions are kept as tables too."""
    spark = df.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n or parts(spark), "segment_hash").option("path", commitlog.scratch(spark, "kept")).saveAsTable(name)
    return spark.table(name)


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: a later round, or a task that is run again, measures nothing twice."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def grown(trials: DataFrame, more: DataFrame) -> DataFrame:
    """trials and more of them, as one table."""
    return kept(trials.unionByName(more.where("vmaf IS NOT NULL").select(*TRIAL)))


def measured(measure: Measure, proposals: DataFrame) -> DataFrame:
    """The trials that came of the proposals; those that could not be measured are left out."""
    return kept(measure(proposals).where("vmaf IS NOT NULL").select(*TRIAL))


def mark(**kinds: str) -> Column:
    """A number for the columns of these names, taken as values of these types. As the first of the keys of a window or join it spares sorts the
    comparing of texts: almost all rows are told apart by 8 bytes. The columns themselves stay keys, so equal marks of others do no harm."""
    return F.xxhash64(*[F.col(c).cast(kind) for c, kind in kinds.items()])


def rate() -> Column:
    return F.when(F.col("ref_bytes") > 0, F.col("out_bytes") / F.col("ref_bytes")).otherwise(1.0)


def rated(trials: DataFrame, targets: DataFrame) -> DataFrame:
    """Measured trials with their rates, against every target (a handful, so they are broadcast)."""
    return trials.where("vmaf IS NOT NULL").withColumn("rate", rate()).crossJoin(F.broadcast(targets))
