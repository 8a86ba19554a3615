"""Models over training rows: ranges, out-of-domain features, splits by source, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.sources.views import FEATURES

TOLERANCE = 0.15
HIT_SLACK = 0.5
#: Ranges of values that a percentile is looked for in.
BINS = 1024


def long_form(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    return features.unpivot(["segment_hash", "source"], list(columns), "feature", "value")


def ranges(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    return long_form(features, columns).groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def violations(features: DataFrame, bounds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Feature values outside their range and a slack of a share of its span (or of its size, if it has no span).
    bounds has a row per feature, so it is broadcast."""
    span = F.col("high") - F.col("low")
    slack = F.when(span > 0, span * tolerance).otherwise(F.greatest(F.abs("high"), F.lit(1.0)) * tolerance)
    return long_form(features).join(F.broadcast(bounds), "feature").where((F.col("value") < F.col("low") - slack) | (F.col("value") > F.col("high") + slack)).select("segment_hash", "feature", "value", "low", "high")


def validation_sources(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """Sources in validation: round(share n) of them, one at least and n - 1 at most, in the order of a seeded hash."""
    sources = rows.select("source").distinct()
    order = W.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source"))), "source")
    counted = sources.withColumns({"place": F.row_number().over(order), "n": F.count(F.lit(1)).over(W.partitionBy())})
    wanted = F.greatest(F.lit(1), F.bround(F.col("n") * share, 0).cast("int"))
    return counted.where(F.col("place") <= F.when(wanted >= F.col("n"), F.greatest(F.lit(1), F.col("n") - 1)).otherwise(wanted)).select("source")


def grouped_split(rows: DataFrame, share: float = 0.25, seed: int = 0) -> DataFrame:
    """rows with validation: all rows of a source are on one side."""
    return rows.join(validation_sources(rows, share, seed).withColumn("validation", F.lit(True)), "source", "left").withColumn("validation", F.coalesce("validation", F.lit(False)))


def regression_metrics(rows: DataFrame, group: str, truth: Column, predicted: Column, slack: float = HIT_SLACK) -> DataFrame:
    e = F.col("__error")
    squares = F.count(F.lit(1)) * F.var_pop("__truth")
    each = rows.select(F.col(group), truth.alias("__truth"), predicted.alias("__predicted")).withColumn("__error", F.col("__predicted") - F.col("__truth"))
    sums = each.groupBy(group).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.when(squares > 0, 1.0 - F.sum(e * e) / F.when(squares > 0, squares)).alias("r2"), F.avg((F.col("__predicted") <= F.col("__truth") + slack).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n")
    )
    return sums.join(percentile_by_counts(each.select(group, F.greatest(e, F.lit(0.0)).alias("__error")), group, "__error", 0.9).withColumnRenamed("value", "overshoot_p90"), group)


def percentile_by_counts(rows: DataFrame, group: str, value: str, share: float, digits: int = 9) -> DataFrame:
    """group and value: the percentile of each group (between two values in proportion), of values taken to some digits.

    Values are counted first, with partial sums, so tasks hold different values only. Their ranks come from a cumulative count by ranges
    of values: a first pass counts in BINS even ranges of each group, and only the ranges that hold the wanted ranks are sorted.
    """
    counted = rows.groupBy(group, F.round(value, digits).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counted.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    place = F.col("share") * (F.col("total") - 1)
    spread = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"))).otherwise(0)
    binned = counted.join(ends, group).withColumn("bin", spread)
    bins = binned.groupBy(group, "bin").agg(F.sum("n").alias("held"), F.max("total").alias("total")).withColumn("share", F.lit(share))
    upto = F.sum("held").over(W.partitionBy(group).orderBy("bin"))  # BINS rows of a group at most
    marked = bins.withColumns({"after": upto, "first": F.floor(place), "last": F.ceil(place), "at": place}).withColumn("before", F.col("after") - F.col("held"))
    some = marked.where(((F.col("first") >= F.col("before")) & (F.col("first") < F.col("after"))) | ((F.col("last") >= F.col("before")) & (F.col("last") < F.col("after"))))
    near = binned.join(some.select(group, "bin", "before", "first", "last", "at"), [group, "bin"])
    ranked = near.withColumn("stop", F.col("before") + F.sum("n").over(W.partitionBy(group, "bin").orderBy("v"))).withColumn("start", F.col("stop") - F.col("n"))
    low, high = (F.max(F.when((F.col(k) >= F.col("start")) & (F.col(k) < F.col("stop")), F.col("v"))) for k in ("first", "last"))
    part = F.max("at") - F.max("first")
    return ranked.groupBy(group).agg((low + (high - low) * part).alias("value"))


def accuracy(rows: DataFrame, group: str, truth: Column, predicted: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.avg((truth == predicted).cast("double")).alias("accuracy"))
