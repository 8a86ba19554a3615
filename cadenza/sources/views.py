"""The engine's input tables, derived by Spark from the given ones.

trials: measured encodes of segments (from lineitem). targets: quality targets. cuts: scene-cut times of a source (from
events). frames and features: frame statistics of clips and segments. records: search records, one JSON document per
segment. probes: media probe JSON (from pages). spaces: the encoders' parameter spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Columns that order the trials of a segment.
SEQ = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

#: The parameter spaces of the encoders (fixed values): crf range, modes, strength range, whole strengths, on a GPU.
SPACES = (
    ("libx265", 18.0, 40.0, [0, 1, 2, 3, 4], 0.0, 2.0, False, False),
    ("libx264", 18.0, 40.0, [0, 1, 2, 3], 0.0, 2.0, False, False),
    ("libsvtav1", 20.0, 55.0, [0, 1], 1.0, 4.0, True, False),
    ("hevc_nvenc", 18.0, 40.0, [0, 1], 1.0, 15.0, True, True),
    ("av1_nvenc", 18.0, 45.0, [0, 1], 1.0, 15.0, True, True),
    ("h264_nvenc", 18.0, 38.0, [0, 1], 1.0, 15.0, True, True),
)
TARGETS = (85.0, 89.0, 93.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(SPACES), "encoder string, crf_min double, crf_max double, aq_modes array<int>, strength_min double, strength_max double, integer_strength boolean, is_gpu boolean"
    )


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TARGETS], "target double")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = 7 * F.col("l_quantity").cast("int") - 5
    lift = (F.col("l_linenumber") % 2) * (1 + F.col("l_suppkey") % 4)
    vmaf = 10600 - 5 * step + 100 * (F.col("l_partkey") % 13 - 6) + 20 * lift
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("seg_"), F.col("l_partkey").cast("string")).alias("segment_hash"),
        F.concat(F.lit("src_"), (F.col("l_partkey") % 20).cast("string")).alias("source"),
        F.lit("libsvtav1").alias("encoder"),
        ((195 + 7 * F.col("l_quantity").cast("int")) / F.lit(10.0)).alias("crf"),
        (F.col("l_linenumber") % 2).cast("int").alias("aq_mode"),
        (1 + F.col("l_suppkey") % 4).cast("double").alias("aq_strength"),
        F.lit("vmaf_v0.6.1neg").alias("vmaf_model"),
        F.lit(2).alias("n_subsample"),
        F.lit(1_000_000).cast("bigint").alias("ref_bytes"),
        (950_000 - 2300 * step - 3000 * lift + 10_000 * (F.col("l_partkey") % 7)).cast("bigint").alias("out_bytes"),
        (F.least(F.lit(10_000), F.greatest(F.lit(0), vmaf)) / F.lit(100.0)).alias("vmaf"),
        *SEQ,
    )


def rated(spark: SparkSession, sf_dir: str, by_segment: bool = False) -> DataFrame:
    """Every trial with its rate, against every target (three rows, so they are broadcast). by_segment: for what goes on by segment; trials are
    dealt out once, before they are multiplied by the targets, and nothing is sorted before it is dealt out."""
    measured = trials(spark, sf_dir)
    with_rate = (measured.repartition("segment_hash") if by_segment else measured).withColumn("rate", F.when(F.col("ref_bytes") > 0, F.col("out_bytes") / F.col("ref_bytes")).otherwise(1.0))
    return with_rate.crossJoin(F.broadcast(targets(spark)))


def _cut_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 3600000000").cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), hour.alias("t"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, its ascending distinct cut times (whole hours) and its duration."""
    return _cut_times(spark, sf_dir).groupBy("source").agg(F.sort_array(F.collect_set("t")).alias("cuts"), (F.max("t") + 1.0).alias("duration"))


def cut_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same as rows: source and t, distinct; source and duration."""
    times = _cut_times(spark, sf_dir)
    return times.distinct(), times.groupBy("source").agg((F.max("t") + 1.0).alias("duration"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixture: eight numbers per segment under the features' names, from the aggregates of its trials, as the given tables hold no frames
    of segments. operators.features.scene computes the features from frames."""
    t = trials(spark, sf_dir)
    return t.groupBy("segment_hash", "source").agg(
        F.round(F.avg("vmaf"), 6).alias("spatial_information"),
        F.round(F.stddev_pop("vmaf"), 6).alias("temporal_information"),
        F.round(F.max("crf"), 6).alias("motion_p95"),
        F.count(F.lit(1)).cast("double").alias("duration"),
        F.round(F.avg(F.col("out_bytes") / F.lit(10_000.0)), 6).alias("luma_mean"),
        F.round(F.min("vmaf"), 6).alias("luma_std"),
        F.round(F.avg("aq_strength"), 6).alias("color_complexity"),
        F.round(F.avg(F.col("l_suppkey").cast("double")), 6).alias("log_pixels"),
    )


FEATURES = ("spatial_information", "temporal_information", "motion_p95", "duration", "luma_mean", "luma_std", "color_complexity", "log_pixels")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media probe document for each page: the shape that a probe tool writes, numbers as strings."""
    n = F.col("page_id")
    video = F.struct(
        F.lit("video").alias("codec_type"),
        (640 + n % 5 * 320).cast("string").alias("width"),
        (360 + n % 5 * 180).cast("string").alias("height"),
        F.element_at(F.array(*map(F.lit, ("30000/1001", "25/1", "0/0", "24000/1001", "60"))), (n % 5 + 1).cast("int")).alias("avg_frame_rate"),
        F.lit("30/1").alias("r_frame_rate"),
        F.when(n % 3 == 0, (n % 400 + 10).cast("string")).alias("nb_frames"),
        F.when(n % 4 != 0, F.concat((n % 90 + 1).cast("string"), F.lit(".5"))).alias("duration"),
        F.when(n % 2 == 0, (n % 1000 * 1000 + 5000).cast("string")).alias("bit_rate"),
        F.lit("h264").alias("codec_name"),
        F.element_at(F.array(*map(F.lit, ("yuv420p", "yuv420p10le", "yuv444p12le", "gbrp", "unknown", "yuvj420p", "rgb24"))), (n % 7 + 1).cast("int")).alias("pix_fmt"),
    )
    audio = F.struct(*[(F.lit("audio") if c == "codec_type" else F.lit(None).cast("string")).alias(c) for c in ("codec_type", "width", "height", "avg_frame_rate", "r_frame_rate", "nb_frames", "duration", "bit_rate", "codec_name", "pix_fmt")])
    streams = F.when(n % 3 == 1, F.array(audio, video)).otherwise(F.array(video))
    form = F.struct(F.length("html").cast("string").alias("size"), F.concat((n % 90 + 2).cast("string"), F.lit(".25")).alias("duration"), F.when(n % 5 != 0, F.lit("800000")).alias("bit_rate"))
    return table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url").alias("path"), F.to_json(F.struct(form.alias("format"), streams.alias("streams"))).alias("probe"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, place, pixels (luma of 8 x 8, 0 to 255, null for every 13th frame) and channels (three, of 8 bits): frames as pictures."""
    f = frames(spark, sf_dir)
    level = F.transform("pixels", lambda p: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128.0 + p * 200.0))))
    shown = f.withColumn("pixels", F.when(F.col("frame") % 13 > 0, F.transform(level, lambda p: p.cast("double"))))
    channels = F.transform(F.array(F.lit(1), F.lit(4), F.lit(16)), lambda k: F.transform("pixels", lambda p: F.floor(p / k).cast("int")))
    return shown.withColumn("channels", channels)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, place, pixels: a clip's frames in order."""
    rows = table(spark, sf_dir, "embeddings")
    order = W.partitionBy("label").orderBy("vec_id")
    return rows.select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), (F.row_number().over(order) - 1).alias("place"), F.col("embedding").cast("array<double>").alias("pixels"))
