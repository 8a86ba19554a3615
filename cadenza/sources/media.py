"""Captured tool output as rows: probes, listings, content hashes, discovery of files."""

from __future__ import annotations

import hashlib
import logging
import re
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions.text import positive, rational
from cadenza.sources import manifests

log = logging.getLogger(__name__)

#: Suffixes of video files (fixed values).
SUFFIXES = ("mp4", "mkv", "mov", "avi", "webm", "m4v", "y4m", "ts")
_STREAM = "codec_type:string,width:string,height:string,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,duration:string,bit_rate:string,codec_name:string,pix_fmt:string"
PROBE = f"format struct<size:string,duration:string,bit_rate:string>, streams array<struct<{_STREAM}>>"


def discover(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """Video files below the folders among the paths, and the files among them whatever their names, each once, in order; their content
    is not read. A path that does not exist is skipped with a warning."""
    conf, folders, single = spark._jsc.hadoopConfiguration(), [], []
    for p in paths:  # a call's arguments
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            log.warning("input not found, skipped: %s", p)
        else:
            (single if fs.getFileStatus(at).isFile() else folders).append(p)
    read = lambda some: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(some).select("path", "length")
    found = spark.createDataFrame([], "path string, length bigint")
    if folders:
        found = found.union(read(folders).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES)))
    if single:
        found = found.union(read(single))
    found = found.distinct().orderBy("path")
    return found if limit is None else found.limit(limit)


def content_hash(content: Column, length: Column, chunk: int = 1 << 20) -> Column:
    """SHA-1 of the size as text and the first, middle and last chunk."""
    middle = F.greatest(F.lit(0), F.floor(length / 2).cast("bigint") - chunk // 2)
    last = F.greatest(F.lit(0), length.cast("bigint") - chunk)
    part = lambda at: F.substring(content, at.cast("int") + 1, F.lit(chunk))
    return F.sha1(F.concat(length.cast("string").cast("binary"), part(F.lit(0)), part(middle), part(last)))


def file_hashes(files: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """path, length and content hash of files (path, length), of which each task reads three chunks and no more, however large they are."""

    def run(batches):
        for batch in batches:
            out = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                local = re.fullmatch(r"(?:file:/*(?=/))?(/.*)", path)
                fs, at = (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(quote(path, safe=":/@"))
                digest = hashlib.sha1(str(length).encode())
                with fs.open_input_file(at) as f:
                    for start in (0, max(0, length // 2 - chunk // 2), max(0, length - chunk)):
                        f.seek(start)
                        digest.update(f.read(chunk))
                out.append(digest.hexdigest())
            yield pa.record_batch({"path": batch.column(0), "length": batch.column(1), "hash": pa.array(out, pa.string())})

    return files.select("path", F.col("length").cast("bigint").alias("length")).mapInArrow(run, "path string, length bigint, hash string")


def media_info(probes: DataFrame) -> DataFrame:
    """Typed rows from probe documents: the first video stream, with fallbacks for what it lacks."""
    p = probes.withColumn("p", F.from_json("probe", PROBE)).withColumn("v", F.filter("p.streams", lambda s: s["codec_type"] == "video")[0]).where(F.col("v").isNotNull())
    zero = F.lit(0.0)
    duration = F.coalesce(positive(rational(F.col("v.duration"))), positive(rational(F.col("p.format.duration"))), zero)
    fps = F.coalesce(positive(rational(F.col("v.avg_frame_rate"))), positive(rational(F.col("v.r_frame_rate"))), zero)
    size = F.col("p.format.size").cast("bigint")
    rate = F.coalesce(positive(rational(F.col("v.bit_rate"))), positive(rational(F.col("p.format.bit_rate"))))
    typed = p.select("page_id", "path", F.col("v.width").cast("int").alias("width"), F.col("v.height").cast("int").alias("height"), fps.alias("fps"), duration.alias("duration"), F.coalesce(F.col("v.nb_frames").cast("bigint"), F.lit(0).cast("bigint")).alias("listed"), F.coalesce("v.codec_name", F.lit("unknown")).alias("codec"), F.coalesce("v.pix_fmt", F.lit("unknown")).alias("pix_fmt"), rate.alias("rate"), size.alias("size_bytes"), F.exists("p.streams", lambda s: s["codec_type"] == "audio").alias("has_audio"))
    frames = F.when(F.col("listed") > 0, F.col("listed")).when((F.col("fps") > 0) & (F.col("duration") > 0), F.bround(F.col("fps") * F.col("duration"), 0).cast("bigint")).otherwise(0)
    bits = F.coalesce("rate", F.when(F.col("duration") > 0, F.col("size_bytes") * 8.0 / F.when(F.col("duration") > 0, F.col("duration"))), F.lit(0.0))
    return typed.select("page_id", "path", "width", "height", "fps", "duration", frames.alias("n_frames"), "codec", "pix_fmt", (bits / 1000.0).alias("bitrate_kbps"), "size_bytes", "has_audio", (F.col("width") * F.col("height")).alias("pixels_per_frame"))


def listing(lines: DataFrame, column: int) -> DataFrame:
    """Names in a column of a tool's listing (doc, pos, line), after its rule of dashes or equals signs."""
    rule = F.max(F.col("line").rlike(r"^\s*(---|===)").cast("int")).over(W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("after", rule).where("after = 1").withColumn("words", F.split(F.trim("line"), r"\s+")).where(F.size("words") > column).select("doc", F.col("words")[column].alias("name")).where("name <> ''").distinct()


def frame_count(lines: DataFrame) -> DataFrame:
    """Of each document (doc, pos, line) the first line that is a whole number, but for commas at its end; null where there is none."""
    token = F.rtrim(F.trim("line"), F.lit(","))
    said = lines.select("doc", F.when(token.rlike(r"^\d+$"), F.struct("pos", token.alias("token"))).alias("t"))
    return said.groupBy("doc").agg(F.min("t")["token"].cast("bigint").alias("n_frames"))


def supported_formats(lines: DataFrame) -> DataFrame:
    """doc and formats, the pixel formats that the first line with such a list names in a tool's help text (doc, pos, line)."""
    mark = "Supported pixel formats:"
    first = lines.where(F.contains("line", F.lit(mark))).groupBy("doc").agg(F.min_by("line", "pos").alias("line"))
    listed = F.split(F.trim(F.regexp_extract("line", f"{mark}(.*)$", 1)), r"\s+")
    found = first.select("doc", F.array_sort(F.array_distinct(F.filter(listed, lambda x: x != ""))).alias("formats"))
    return lines.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("formats", F.array().cast("array<string>")).alias("formats"))


def bundles(metadata: DataFrame) -> DataFrame:
    """Model bundles (path, encoder, target, low, high, heads), each once: all those of a target, and of those for all targets the ones
    with every head."""
    whole = F.array_contains("heads", "crf") & F.array_contains("heads", "aq_mode") & F.array_contains("heads", "aq_strength")
    return metadata.where(F.col("target").isNotNull() | whole).dropDuplicates(["path"])


def scan_bundles(spark: SparkSession, root: str) -> DataFrame:
    """The bundles that training.save put below root (at any depth): path, encoder, target, low and high (of the targets that it was trained
    on), heads. Folders whose metadata do not parse, or are of another version, are passed over."""
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(root)
    at = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/metadata/part-[^/]*$", 1)
    said = files.select(at.alias("path"), F.col("value").alias("document")).where("path <> ''")
    m = manifests.metadata(said)
    heads = F.filter(F.array(*[F.lit(h) for h in ("crf", "aq_mode", "aq_strength")]), lambda h: F.map_contains_key("config", F.concat(F.lit("head_"), h)))
    return bundles(m.select("path", "encoder", "target", F.array_min("training_targets").alias("low"), F.array_max("training_targets").alias("high"), heads.alias("heads")))


def find_bundle(asked: DataFrame, known: DataFrame, slack: float = 0.5) -> DataFrame:
    """For each encoder and target the bundle made for that target, else one for all targets of the encoder: path, and fits, whether the
    target lies in the range that it was trained on (with some slack; a bundle without a recorded range fits always). No path: there
    is no model. The greatest path counts among several. must_find turns what does not fit or is not there into an error."""
    exact = known.where("target IS NOT NULL").groupBy("encoder", "target").agg(F.max("path").alias("own"))
    wide = known.where("target IS NULL").select("encoder", F.col("path").alias("shared"), "low", "high")
    fits = F.col("low").isNull() | F.col("high").isNull() | ((F.col("target") >= F.col("low") - slack) & (F.col("target") <= F.col("high") + slack))
    met = asked.join(exact, ["encoder", "target"], "left").join(wide, "encoder", "left")
    best = met.groupBy("encoder", "target").agg(F.max("own").alias("own"), F.max(F.when(F.col("shared").isNotNull(), F.struct("shared", fits.alias("fits")))).alias("w"))
    return best.select("encoder", "target", F.coalesce("own", "w.shared").alias("path"), F.when(F.col("own").isNotNull(), True).otherwise(F.coalesce("w.fits", F.lit(False))).alias("fits"))


def must_find(found: DataFrame) -> DataFrame:
    """The rows of find_bundle without fits; reading one that lacks a model or lies out of range is an error."""
    why = F.when(F.col("path").isNull(), F.lit("no model for ")).otherwise(F.lit("outside of the trained range: "))
    return found.select("encoder", "target", F.when(F.col("path").isNotNull() & F.col("fits"), F.col("path")).otherwise(F.raise_error(F.concat(why, F.col("encoder"), F.lit(" "), F.col("target").cast("string"))).cast("string")).alias("path"))


def must_be_plausible(rows: DataFrame) -> DataFrame:
    """rows of quality_rows; reading one with a score outside of 0 to 100, or without scores, is an error."""
    said = F.concat(F.lit("implausible scores of "), F.col("segment_hash"))
    return rows.withColumn("mean", F.when(F.col("plausible") & F.col("mean").between(0, 100), F.col("mean")).otherwise(F.raise_error(said).cast("double")))


#: The shape of a quality tool's log.
QUALITY_LOG = "frames array<struct<frameNum:int,metrics:struct<vmaf:double>>>, pooled_metrics struct<vmaf:struct<mean:double,harmonic_mean:double,min:double>>"


def quality_rows(logs: DataFrame) -> DataFrame:
    """A row per log: its pooled numbers, how many frames it lists, and whether all scores are plausible."""
    parsed = logs.withColumn("q", F.from_json("log", QUALITY_LOG))
    plausible = F.forall("q.frames", lambda f: f["metrics"]["vmaf"].between(0, 100))
    return parsed.select("segment_hash", F.size("q.frames").cast("bigint").alias("n_frames"), F.col("q.pooled_metrics.vmaf.mean").alias("mean"), F.col("q.pooled_metrics.vmaf.harmonic_mean").alias("harmonic"), F.col("q.pooled_metrics.vmaf.min").alias("least"), plausible.alias("plausible"))
