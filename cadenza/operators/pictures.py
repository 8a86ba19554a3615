"""Scene features from pictures: frames as bytes, a few numpy operations for each, in Arrow batches.

A frame is read where it lies: brought to the width of the analysis (area averages) if it is wider, taken to grey, and summed up. Only
its small grey picture is shuffled, by clip, where each is compared with the one before it; tasks pass over a clip's pictures in order and
hold two of them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.modeling import percentile_by_counts

ANALYSIS_WIDTH = 640
#: Shares of blue, green and red in grey, of 2^14 (fixed values).
GREY = (1868, 9617, 4899)


@functools.lru_cache(maxsize=64)
def area_weights(n: int, m: int) -> np.ndarray:
    """m x n: each of m even stretches of n pixels as the mean of what it covers, parts of pixels by their share."""
    edges = np.arange(m + 1) * (n / m)
    pixels = np.arange(n)
    covered = np.minimum(edges[1:, None], pixels + 1) - np.maximum(edges[:-1, None], pixels)
    return (np.maximum(covered, 0) * (m / n)).astype(np.float32)


def shrunk(frame: np.ndarray, width: int) -> np.ndarray:
    """A frame (height, width, channels) brought to a width, if it is wider, by area averages, rounded to bytes."""
    h, w, _ = frame.shape
    if w <= width:
        return frame
    rows = max(2, round(h * width / w))
    if w % width == 0 and h % rows == 0:
        out = frame.reshape(rows, h // rows, width, w // width, -1).mean(axis=(1, 3), dtype=np.float32)
    else:
        across = np.einsum("xw,hwc->hxc", area_weights(w, width), frame.astype(np.float32), optimize=True)
        out = np.einsum("yh,hxc->yxc", area_weights(h, rows), across, optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def grey(frame: np.ndarray) -> np.ndarray:
    """Bytes of luma of a frame with blue, green and red, or with luma alone."""
    if frame.shape[2] == 1:
        return frame[:, :, 0]
    b, g, r = (frame[:, :, i].astype(np.uint32) * s for i, s in enumerate(GREY))
    return ((b + g + r + (1 << 13)) >> 14).astype(np.uint8)


def edge_spread(luma: np.ndarray) -> float:
    """The standard deviation of gradient lengths by 3 x 3 Sobel kernels, mirrored about the outermost pixels."""
    p = np.pad(luma.astype(np.float32), 1, mode="reflect")
    down = p[:-2] + 2 * p[1:-1] + p[2:]
    along = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return float(np.hypot(down[:, 2:] - down[:, :-2], along[2:] - along[:-2]).std(dtype=np.float64))


def entropy(channel: np.ndarray) -> float:
    """The Shannon entropy, in bits, of bytes."""
    p = np.bincount(channel.ravel(), minlength=256) / channel.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


_STATS = "clip long, place long, height int, luma double, luma_spread double, edges double, colour double, grey binary"


def frame_stats(frames: DataFrame, width: int = ANALYSIS_WIDTH) -> DataFrame:
    """A row for each frame (clip, place, width, height, data: rows of pixels of one or three bytes) that could be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {name: [] for name in ("clip", "place", "height", "luma", "luma_spread", "edges", "colour", "grey")}
            for clip, place, w, h, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                frame = shrunk(np.frombuffer(data, np.uint8).reshape(h, w, -1), width)
                luma = grey(frame)
                said = (clip, place, len(luma), float(luma.mean()), float(luma.std()), edge_spread(luma), float(np.mean([entropy(frame[:, :, c]) for c in range(frame.shape[2])])), luma.tobytes())
                for name, value in zip(rows, said, strict=True):
                    rows[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.record_batch({name: pa.array(v, k) for (name, v), k in zip(rows.items(), kinds, strict=True)})

    pixels = F.octet_length("data")
    whole = (F.col("width") >= 2) & (F.col("height") >= 2) & pixels.isin(F.col("width") * F.col("height"), 3 * F.col("width") * F.col("height"))
    read = frames.where(F.col("data").isNotNull() & whole).select(F.col("clip").cast("long"), F.col("place").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "data")
    return read.mapInArrow(run, _STATS)


def _moved(stats: DataFrame) -> DataFrame:
    """clip, moved and moved_spread: the mean and spread of the difference of each picture and the one before it, if they are of one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            clips, means, spreads = [], [], []
            for clip, height, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                now = (clip, height, np.frombuffer(data, np.uint8).astype(np.int16))
                if before and before[:2] == now[:2] and len(before[2]) == len(now[2]):
                    apart = np.abs(now[2] - before[2])
                    clips.append(clip)
                    means.append(float(apart.mean()))
                    spreads.append(float(apart.std()))
                before = now
            yield pa.record_batch({"clip": pa.array(clips, pa.int64()), "moved": pa.array(means, pa.float64()), "moved_spread": pa.array(spreads, pa.float64())})

    ordered = stats.select("clip", "height", "grey", "place").repartition("clip").sortWithinPartitions("clip", "place")
    return ordered.select("clip", "height", "grey").mapInArrow(run, "clip long, moved double, moved_spread double")


def scene(frames: DataFrame, clips: DataFrame, width: int = ANALYSIS_WIDTH) -> DataFrame:
    """The eight features of each clip (clip, duration, pixels_per_frame) from its frames, as features.scene gives them from arrays of luma:
    frames whose bytes do not fit their size, or that lack data, could not be read. Fewer than two make an error."""
    stats = frame_stats(frames, width)
    none = F.lit(0.0)
    per = stats.groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames"), F.avg("edges").alias("spatial_information"), F.avg("luma").alias("luma_mean"), F.avg("luma_spread").alias("luma_std"), F.avg("colour").alias("color_complexity"))
    moved = _moved(stats)
    spread = moved.groupBy("clip").agg(F.avg("moved_spread").alias("temporal_information"))
    high = percentile_by_counts(moved.select("clip", (F.col("moved") / 255.0).alias("share")), "clip", "share", 0.95, 12).withColumnRenamed("value", "motion_p95")
    enough = F.when(F.col("n_frames") >= 2, F.col("n_frames")).otherwise(F.raise_error(F.concat(F.lit("fewer than two frames of clip "), F.col("clip").cast("string"))).cast("bigint"))
    joined = per.join(clips, "clip").join(spread, "clip", "left").join(high, "clip", "left")
    return joined.select(
        "clip", enough.alias("n_frames"), "spatial_information", F.coalesce("temporal_information", none).alias("temporal_information"), F.coalesce("motion_p95", none).alias("motion_p95"),
        "duration", "luma_mean", "luma_std", "color_complexity", F.log10(F.greatest(F.lit(1), F.col("pixels_per_frame")).cast("double")).alias("log_pixels"),
    )
