"""The objective of an encode, and its parts, as column expressions.

A rate of MIN_USEFUL_RATE or more, or a quality more than SOFT_MARGIN below the target, scores 0; below the target
a soft zone; at or above it a weighted sum of compression and quality. The order of the cases matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the objective.
COMPRESSION_WEIGHT = 0.70
QUALITY_WEIGHT = 0.30
SOFT_MARGIN = 5.0
MIN_USEFUL_RATE = 0.80
NORMALIZATION = 1.12


def compression_ratio(rate: Column) -> Column:
    return F.when(rate > 0, F.lit(1.0) / rate).otherwise(0.0)


def above_component(ratio: Column) -> Column:
    return F.when(ratio <= 20.0, F.pow((ratio - 1.25) / F.lit(18.75), F.lit(0.9))).otherwise(1.0 + 0.1 * F.ln(ratio / F.lit(20.0)))


def soft_component(ratio: Column) -> Column:
    return F.when(ratio <= 20.0, F.pow((ratio - 1.0) / F.lit(19.0), F.lit(1.5))).otherwise(1.0 + 0.3 * F.ln(ratio / F.lit(20.0)))


def components(vmaf: Column, rate: Column, target: Column, soft_margin: float = SOFT_MARGIN) -> tuple[Column, Column]:
    """The compression and the quality component."""
    ratio, floor = compression_ratio(rate), target - soft_margin
    none = (rate >= MIN_USEFUL_RATE) | (vmaf < floor)
    room = F.lit(100.0) - target
    excess = F.when(room > 0, F.least(F.lit(1.0), (vmaf - target) / F.when(room > 0, room))).otherwise(1.0)
    compression = F.when(none, 0.0).when(vmaf < target, soft_component(ratio)).otherwise(above_component(ratio))
    quality = F.when(none, 0.0).when(vmaf < target, 0.7 * F.pow((vmaf - floor) / F.lit(soft_margin), F.lit(2.0))).otherwise(0.7 + 0.3 * excess)
    return compression, quality


def score(vmaf: Column, rate: Column, target: Column, *, compression_weight: float = COMPRESSION_WEIGHT, quality_weight: float = QUALITY_WEIGHT, soft_margin: float = SOFT_MARGIN) -> Column:
    if abs(compression_weight + quality_weight - 1.0) > 1e-9:
        raise ValueError(f"the weights must add up to 1, not {compression_weight + quality_weight}")
    compression, quality = components(vmaf, rate, target, soft_margin)
    raw = F.when((rate >= MIN_USEFUL_RATE) | (vmaf < target - soft_margin), 0.0).when(vmaf < target, compression * quality).otherwise(compression_weight * compression + quality_weight * quality)
    return F.least(F.lit(1.0), raw / F.lit(NORMALIZATION))


def with_score(rated: DataFrame, soft_margin: float = SOFT_MARGIN) -> DataFrame:
    """rated (vmaf, rate, target and more) with compression, quality, score, proxy and feasible, each worked out once per row.

    Every step names what the next ones refer to, so that no part of the formula is repeated in another.
    """
    c = F.col
    room = F.lit(100.0) - c("target")
    excess = F.when(room > 0, F.least(F.lit(1.0), (c("vmaf") - c("target")) / F.when(room > 0, room))).otherwise(1.0)
    zone = F.when((c("rate") >= MIN_USEFUL_RATE) | (c("vmaf") < c("target") - soft_margin), 0).when(c("vmaf") < c("target"), 1).otherwise(2)
    by_zone = lambda soft, met: F.when(c("zone") == 0, 0.0).when(c("zone") == 1, soft).otherwise(met)
    parts = rated.withColumns({"ratio": compression_ratio(c("rate")), "zone": zone}).withColumns(
        {"compression": by_zone(soft_component(c("ratio")), above_component(c("ratio"))), "quality": by_zone(0.7 * F.pow((c("vmaf") - (c("target") - soft_margin)) / F.lit(soft_margin), F.lit(2.0)), 0.7 + 0.3 * excess)}
    )
    whole = by_zone(c("compression") * c("quality"), COMPRESSION_WEIGHT * c("compression") + QUALITY_WEIGHT * c("quality"))
    scored = parts.withColumn("score", F.least(F.lit(1.0), whole / F.lit(NORMALIZATION)))
    return scored.withColumns({"proxy": F.when(c("score") > 0, c("score")).otherwise(1e-6 * F.least("vmaf", "target")), "feasible": feasible(c("vmaf"), c("rate"), c("target"))}).drop("ratio", "zone")


def reason(vmaf: Column, rate: Column, target: Column, soft_margin: float = SOFT_MARGIN) -> Column:
    """Why a trial scores as it does. The texts are fixed values: users search their logs for them."""
    ratio, floor = compression_ratio(rate), target - soft_margin
    _, quality = components(vmaf, rate, target, soft_margin)
    return (
        F.when(rate >= MIN_USEFUL_RATE, F.format_string("no meaningful compression (ratio %.2fx, rate %.3f); at least 1.25x required", ratio, rate))
        .when(vmaf < floor, F.format_string("VMAF %.2f below hard cutoff %.2f", vmaf, floor))
        .when(vmaf < target, F.format_string("VMAF %.2f in soft zone (quality factor %.2f)", vmaf, quality))
        .otherwise(F.when(ratio < 10.0, "success").otherwise("success (excellent compression)"))
    )


def feasible(vmaf: Column, rate: Column, target: Column) -> Column:
    return (vmaf >= target) & (rate < MIN_USEFUL_RATE)


def proxy(vmaf: Column, rate: Column, target: Column) -> Column:
    """What trials are ranked by: the score, or else how near the quality is to the target."""
    s = score(vmaf, rate, target)
    return F.when(s > 0, s).otherwise(1e-6 * F.least(vmaf, target))
