"""Frame statistics: sampling, motion between frames, entropy, pooled quality, frame counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.operators.modeling import percentile_by_counts

SHORT_FRAMES = 4


def sample_places(total: Column, wanted: int) -> Column:
    """Even places between 5 % and 95 % of the frames; all of them if there are no more than wanted."""
    lo = F.floor(total * F.lit(0.05))
    hi = F.greatest(lo + 1, F.floor(total * F.lit(0.95)))
    even = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround((lo + (hi - 1 - lo) * i / F.lit(max(1, wanted - 1))).cast("double"), 0).cast("int"))
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= wanted, F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)).cast("int"))).otherwise(even)


def sampled(frames: DataFrame, wanted: int) -> DataFrame:
    sizes = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("total"))
    places = sizes.select("clip", F.explode(F.array_distinct(sample_places(F.col("total"), wanted))).alias("place"))
    return frames.join(places, ["clip", "place"])


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def _spread(values: Column, mean: Column) -> Column:
    """The standard deviation of values whose mean is known."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size(values))


def edge_strengths(pixels: Column, width: int) -> Column:
    """For every pixel of a row-wise picture the length of its gradient by 3 x 3 Sobel kernels; beyond an edge the picture is mirrored
    about the outermost pixels."""
    height = F.floor(F.size(pixels) / F.lit(width)).cast("int")
    mirrored = lambda i, n: F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)

    def at(i: Column, dy: int, dx: int) -> Column:
        y, x = F.floor(i / F.lit(width)).cast("int") + dy, i % width + dx
        return F.get(pixels, mirrored(y, height) * width + mirrored(x, F.lit(width)))

    def strength(i: Column) -> Column:
        gx = at(i, -1, 1) + 2 * at(i, 0, 1) + at(i, 1, 1) - at(i, -1, -1) - 2 * at(i, 0, -1) - at(i, 1, -1)
        gy = at(i, 1, -1) + 2 * at(i, 1, 0) + at(i, 1, 1) - at(i, -1, -1) - 2 * at(i, -1, 0) - at(i, -1, 1)
        return F.sqrt(gx * gx + gy * gy)

    return F.transform(F.sequence(F.lit(0), F.size(pixels) - 1), strength)


def histogram_entropy(channel: Column) -> Column:
    """The Shannon entropy, in bits, of a channel's 8-bit values."""
    held = F.array_sort(channel)
    step = lambda a, x: F.when(x == a["v"], F.struct(x.alias("v"), (a["n"] + 1.0).alias("n"), a["s"].alias("s"))).otherwise(F.struct(x.alias("v"), F.lit(1.0).alias("n"), (a["s"] + F.when(a["n"] > 0, a["n"] * F.log2(a["n"])).otherwise(0.0)).alias("s")))
    size = F.size(channel).cast("double")
    return F.aggregate(held, F.struct(F.lit(-1).alias("v"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s")), step, lambda a: F.log2(size) - (a["s"] + a["n"] * F.log2(F.greatest(a["n"], F.lit(1.0)))) / size)


def scene(frames: DataFrame, clips: DataFrame, width: int) -> DataFrame:
    """The eight features of each clip (clip, duration, pixels_per_frame) from its frames (clip, place, pixels: luma from 0 to 255, row by
    row, null where reading failed; channels: arrays of 8-bit values).

    Means over frames of the spread of edge strengths, of luma and its spread, and of the channels' entropy; of each frame and the one
    before it that could be read, if of the same size, the spread of the difference, and the 95th percentile of its mean as a share of
    255. Fewer than two frames make an error.
    """
    read = frames.where(F.col("pixels").isNotNull() & (F.size("pixels") > 0))
    before = F.lag("pixels").over(W.partitionBy("clip").orderBy("place"))
    apart = F.when(F.size("pixels") == F.size("before"), F.zip_with("pixels", "before", lambda a, b: F.abs(a - b)))
    steps = (
        read.withColumns({"before": before, "edges": edge_strengths(F.col("pixels"), width)})
        .withColumn("apart", apart)
        .withColumns({"luma": _mean(F.col("pixels")), "edge": _mean(F.col("edges")), "moved": _mean(F.col("apart")), "colour": _mean(F.transform("channels", histogram_entropy))})
        .withColumns({"luma_spread": _spread(F.col("pixels"), F.col("luma")), "edge_spread": _spread(F.col("edges"), F.col("edge")), "moved_spread": _spread(F.col("apart"), F.col("moved"))})
    )
    none = F.lit(0.0)
    per = steps.groupBy("clip").agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg("edge_spread").alias("spatial_information"), F.coalesce(F.avg("moved_spread"), none).alias("temporal_information"), F.coalesce(F.percentile(F.col("moved") / 255.0, 0.95), none).alias("motion_p95"),
        F.avg("luma").alias("luma_mean"), F.avg("luma_spread").alias("luma_std"), F.avg("colour").alias("color_complexity"),
    )
    enough = F.when(F.col("n_frames") >= 2, F.col("n_frames")).otherwise(F.raise_error(F.concat(F.lit("fewer than two frames of clip "), F.col("clip").cast("string"))).cast("bigint"))
    return per.join(clips, "clip").select("clip", enough.alias("n_frames"), "spatial_information", "temporal_information", "motion_p95", "duration", "luma_mean", "luma_std", "color_complexity", F.log10(F.greatest(F.lit(1), F.col("pixels_per_frame")).cast("double")).alias("log_pixels"))


def paired(reference: DataFrame, distorted: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of two streams (keys, frame, score columns) side by side by their number in the stream, never by their time."""
    number = lambda df, name: df.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("frame")) - 1).select(*keys, "n", F.col("frame").alias(f"{name}_frame"), F.col("value").alias(name))
    return number(reference, "reference").join(number(distorted, "distorted"), [*keys, "n"])


def motion(frames: DataFrame) -> DataFrame:
    """Per clip the mean, 95th percentile and spread of the mean absolute difference of consecutive frames of equal size."""
    before = F.lag("pixels").over(W.partitionBy("clip").orderBy("place"))
    apart = F.aggregate(F.zip_with("pixels", "before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x) / F.size("pixels")
    moved = frames.withColumn("before", before).withColumn("apart", F.when(F.size("pixels") == F.size("before"), apart))
    level = F.aggregate("pixels", F.lit(0.0), lambda acc, x: acc + x) / F.size("pixels")
    steps = moved.withColumn("level", level)
    sums = steps.groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames"), F.coalesce(F.avg("apart"), F.lit(0.0)).alias("motion_mean"), F.avg("level").alias("luma_mean"), F.stddev_pop("level").alias("luma_std"))
    high = percentile_by_counts(steps.where("apart IS NOT NULL").select("clip", "apart"), "clip", "apart", 0.95, 12)
    return sums.join(high, "clip", "left").withColumn("motion_p95", F.coalesce("value", F.lit(0.0))).drop("value")


def entropy(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The Shannon entropy, in bits, of the values of each group."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    # -sum p log2 p = log2 N - sum(n log2 n) / N, so no second pass over the counts is needed
    return counts.groupBy(group).agg((F.log2(total.cast("double")) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))


def expected_frames(n: Column, step: int) -> Column:
    return F.when(n <= 0, 0).otherwise(F.floor((n - 1) / F.lit(max(1, step))) + 1).cast("long")


def count_trusted(scored: Column, frames: Column, step: int) -> Column:
    """Whether that many scored frames fit the source: one too many at most, or a few lost at the end."""
    wanted = expected_frames(frames, step)
    return (scored <= wanted + 1) & (scored >= wanted - expected_frames(F.lit(SHORT_FRAMES), step))


def pooled(scores: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, harmonic mean (n / sum 1/x; null if some score is not positive) and least of plausible scores."""
    x = F.col(value)
    return scores.where(x.between(0, 100)).groupBy(group).agg(F.avg(x).alias("mean"), F.when(F.min(x) > 0, F.count(x) / F.sum(F.when(x > 0, F.lit(1.0) / F.when(x > 0, x)))).alias("harmonic"), F.min(x).alias("least"), F.count(x).alias("n_scores"))
