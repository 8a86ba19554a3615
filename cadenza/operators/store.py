"""Stored trials and checkpoints: pending work, lookup, upsert, last complete records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions.params import params_key, trial_key
from cadenza.sources import commitlog

#: A search record's JSON, whose results have a key for each target.
RECORD = (
    "segment_path string, segment_hash string, source string, encoder string, features map<string,double>, results map<string,struct<feasible:boolean,vmaf:double,rate:double,ratio:double,score:double,n_trials:bigint,"
    "params:struct<crf:double,aq_mode:int,aq_strength:double>,top_params:array<struct<params:struct<crf:double,aq_mode:int,aq_strength:double>,vmaf:double,rate:double,ratio:double,score:double>>>>"
)


def pending(segments: DataFrame, done: DataFrame) -> DataFrame:
    return segments.join(done, "segment_hash", "left_anti")


def reused(sources: DataFrame, segments: DataFrame, done: DataFrame) -> DataFrame:
    """Sources with a finished segment."""
    return sources.join(segments.join(done, "segment_hash", "left_semi").select("source").distinct(), "source", "left_semi")


def key() -> Column:
    return trial_key(F.col("segment_hash"), F.col("encoder"), params_key(F.col("crf"), F.col("aq_mode"), F.col("aq_strength")), F.col("vmaf_model"), F.col("n_subsample"))


def upsert(trials: DataFrame, order: list[str]) -> DataFrame:
    """One row per key: the last written."""
    last = W.partitionBy("key").orderBy(*[F.desc(c) for c in order])
    return trials.withColumn("key", key()).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def lookup(proposals: DataFrame, stored: DataFrame) -> DataFrame:
    """Proposals with what is stored under their key; hit says whether there is something."""
    known = stored.select("key", F.col("vmaf").alias("stored_vmaf"), F.col("out_bytes").alias("stored_bytes"))
    return proposals.withColumn("key", key()).join(known, "key", "left").withColumn("hit", F.col("stored_vmaf").isNotNull())


def latest_records(lines: DataFrame, encoder: str, targets: list[float]) -> DataFrame:
    """Of the checkpoint lines (pos, line) the last of each segment that parses, is of the encoder and has all targets."""
    parsed = lines.where(F.trim("line") != "").withColumn("r", F.from_json("line", RECORD)).where("r.segment_hash IS NOT NULL")
    has = F.transform(F.map_keys("r.results"), lambda k: k.try_cast("double"))
    full = parsed.where((F.col("r.encoder") == encoder) & (F.size(F.array_except(F.array(*map(F.lit, targets)), has)) == 0))
    last = W.partitionBy("segment_hash").orderBy(F.desc("pos"))
    dealt = full.select("pos", "r.*").repartition("segment_hash")  # whole records are sorted where they meet only
    return dealt.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def append_records(records: DataFrame, path: str) -> int:
    """Adds records to a checkpoint folder as one batch of JSON lines, and returns the batch's number."""
    return commitlog.append(records.select(F.to_json(F.struct(*records.columns)).alias("value")), path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a checkpoint with their places: of append_records' batches in the order of their commits, so that the last line written
    has the largest pos; of other folders of files in the order of the files' names and of the lines in each. Files of any size are read in blocks."""
    if commitlog.exists(spark, path):
        return commitlog.lines(spark, path)
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return rows.select(F.struct("file", "block", F.monotonically_increasing_id().alias("n")).alias("pos"), "line")


def compact_checkpoint(spark: SparkSession, path: str, encoder: str, targets: list[float]) -> int:
    """Replaces a checkpoint's batches by one that holds the last complete record of each segment; the number of that batch."""
    last = latest_records(commitlog.lines(spark, path), encoder, targets).drop("pos")
    return commitlog.append(last.select(F.to_json(F.struct(*last.columns)).alias("value")), path, replaces=True)


def checkpoint_lines(df: DataFrame) -> DataFrame:
    """Small whole texts (value) as lines with their places; read_checkpoint is for files."""
    return df.select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
