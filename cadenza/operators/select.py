"""Choosing trials and settings: top-k, best or closest, best and ranked AQ settings, CRF brackets and guesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions import scoring
from cadenza.sources.views import SEQ

TOP_K = 5
GOLDEN = (5**0.5 - 1) / 2


def scored(rated: DataFrame) -> DataFrame:
    return scoring.with_score(rated).drop("compression", "quality")


def top_trials(rated: DataFrame, k: int = TOP_K, seq: tuple[str, ...] = SEQ) -> DataFrame:
    """The k best feasible trials of each segment and target, earlier ones first among equals."""
    order = W.partitionBy("segment_hash", "target").orderBy(F.desc("score"), *seq)
    return scored(rated.where(scoring.feasible(F.col("vmaf"), F.col("rate"), F.col("target")))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k))


def best_or_closest(rated: DataFrame, seq: tuple[str, ...] = SEQ) -> DataFrame:
    """The best feasible trial of each segment and target; where there is none, the one of highest quality."""
    order = W.partitionBy("segment_hash", "target").orderBy(F.desc("feasible"), F.desc(F.when(F.col("feasible"), F.col("score")).otherwise(F.col("vmaf"))), *seq)
    return scored(rated).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def best_per_aq(rated: DataFrame, seq: tuple[str, ...] = SEQ) -> DataFrame:
    """For each segment, target and AQ setting its best trial: feasible ones by score, else by proxy."""
    order = W.partitionBy("segment_hash", "target", "aq_mode", "aq_strength").orderBy(F.desc("feasible"), F.desc(F.when(F.col("feasible"), F.col("score")).otherwise(F.col("proxy"))), *seq)
    return scored(rated).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def best_aq(rated: DataFrame, seq: tuple[str, ...] = SEQ) -> DataFrame:
    """The AQ setting whose best trial has the highest proxy; of equals the smaller setting."""
    order = W.partitionBy("segment_hash", "target").orderBy(F.desc("proxy"), "aq_mode", "aq_strength")
    return best_per_aq(rated, seq).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def rank_aq(rated: DataFrame, n: int | None = None, seq: tuple[str, ...] = SEQ) -> DataFrame:
    """AQ settings by their highest proxy (0 at least), settings met earlier first among equals; the first n."""
    first = F.min(F.struct(*seq)).alias("first")
    groups = scored(rated).groupBy("segment_hash", "target", "aq_mode", "aq_strength").agg(F.greatest(F.lit(0.0), F.max("proxy")).alias("value"), first)
    ranked = groups.withColumn("rank", F.row_number().over(W.partitionBy("segment_hash", "target").orderBy(F.desc("value"), "first"))).drop("first")
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def crf_samples(rated: DataFrame, seq: tuple[str, ...] = SEQ) -> DataFrame:
    """One quality for each crf of a segment, AQ setting and target: the last measured."""
    order = W.partitionBy("segment_hash", "aq_mode", "aq_strength", "target", "crf").orderBy(*[F.desc(c) for c in seq])
    return rated.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def crf_bracket(rated: DataFrame, seq: tuple[str, ...] = SEQ, n_last: int = 0) -> DataFrame:
    """low: the highest crf that meets the target; high: the lowest above it that does not; each with its quality. n_last: history holds so many
    of the points (crf, vmaf), those measured last, in their order."""
    group = ["segment_hash", "aq_mode", "aq_strength", "target"]
    meets = F.col("vmaf") >= F.col("target")
    samples = crf_samples(rated, seq).withColumn("low", F.max(F.when(meets, F.col("crf"))).over(W.partitionBy(*group)))
    above = ~meets & (F.col("low").isNull() | (F.col("crf") > F.col("low")))
    at = lambda which: F.when(which, F.struct("crf", "vmaf"))
    found = [F.max(at(meets)).alias("lo"), F.min(at(above)).alias("hi")]
    ends = [F.col(f"{side}.{c}").alias(f"{c}_{end}") for side, end in (("lo", "low"), ("hi", "high")) for c in ("crf", "vmaf")]
    if n_last:
        samples = samples.withColumn("n", F.row_number().over(W.partitionBy(*group).orderBy(*[F.desc(c) for c in seq])))
        last = F.when(F.col("n") <= n_last, F.struct((-F.col("n")).alias("n"), "crf", "vmaf"))
        found, ends = [*found, F.array_sort(F.collect_list(last)).alias("history")], [*ends, "history"]
    return samples.groupBy(*group).agg(*found).select(*group, *ends)


def crf_guess(method: str, lo, vmaf_lo, hi, vmaf_hi, target, history=None):
    """The next crf to try between lo and hi: golden section, inverse quadratic (brent) where three points allow, else secant or the middle."""
    span = hi - lo
    if method == "golden":
        return lo + (1.0 - GOLDEN) * span
    secant = F.when(vmaf_lo > vmaf_hi, lo + (vmaf_lo - target) * span / F.when(vmaf_lo > vmaf_hi, vmaf_lo - vmaf_hi)).otherwise(0.5 * (lo + hi))
    return F.coalesce(inverse_quadratic(history, target), secant) if method == "brent" and history is not None else secant


def inverse_quadratic(history, target):
    """crf as a quadratic function of quality through the last three points (crf, vmaf); null if there are fewer or two agree in quality."""
    p = F.slice(history, -3, 3)
    x, y = ([F.try_element_at(p, F.lit(i + 1))[f] for i in range(3)] for f in ("crf", "vmaf"))
    term = lambda i, j, k: F.try_divide((target - y[j]) * (target - y[k]), (y[i] - y[j]) * (y[i] - y[k])) * x[i]
    differ = (y[0] != y[1]) & (y[1] != y[2]) & (y[0] != y[2])
    return F.when((F.size(history) >= 3) & differ, term(0, 1, 2) + term(1, 0, 2) + term(2, 0, 1))


def with_guess(bracket: DataFrame, method: str = "secant") -> DataFrame:
    """guess: the next crf of each bracket, a fifth of its width from either end at least; null if an end is missing. brent goes by
    history, an array of points (crf, vmaf) in the order of their measurement."""
    c = F.col
    history = c("history") if "history" in bracket.columns else None
    if method == "brent" and history is None:
        raise ValueError("brent needs a history of points")
    guess = crf_guess(method, c("crf_low"), c("vmaf_low"), c("crf_high"), c("vmaf_high"), c("target"), history)
    margin = 0.2 * (c("crf_high") - c("crf_low"))
    return bracket.withColumn("guess", F.when(c("crf_low").isNotNull() & c("crf_high").isNotNull(), F.least(F.greatest(guess, c("crf_low") + margin), c("crf_high") - margin)))


def clamped_guess(bracket: DataFrame, method: str = "secant") -> DataFrame:
    return with_guess(bracket, method).where("guess IS NOT NULL")


def explored_range(rated: DataFrame) -> DataFrame:
    """How far the trials of a segment reach, and how many there are."""
    return rated.groupBy("segment_hash", "target").agg(F.min("vmaf").alias("vmaf_min"), F.max("vmaf").alias("vmaf_max"), F.count(F.lit(1)).alias("n_trials"))


def good_bad(rated: DataFrame, gamma: float = 0.25, floor: float = 0.08) -> DataFrame:
    """Trials of a segment and target split by proxy: max(2, ceil(gamma n)) good ones and the rest; mean and spread of the crf
    of each (as a share of 20..55), the spread floor at least. With no rest the last two stand for it."""
    part = W.partitionBy("segment_hash", "target")
    n_good = F.greatest(F.lit(2), F.ceil(gamma * F.col("n")).cast("int"))
    ranked = scored(rated).withColumns({"place": F.row_number().over(part.orderBy(F.desc("proxy"), *SEQ)), "n": F.count(F.lit(1)).over(part)})
    u = (F.col("crf") - 20.0) / F.lit(35.0)
    good = F.col("place") <= n_good
    bad = F.when(F.col("n") > n_good, ~good).otherwise(F.col("place") > F.col("n") - 2)
    stats = lambda side, name: [F.avg(F.when(side, u)).alias(f"{name}_mean"), F.greatest(F.stddev_pop(F.when(side, u)), F.lit(floor)).alias(f"{name}_std")]
    return ranked.where("n >= 4").groupBy("segment_hash", "target").agg(F.sum(good.cast("int")).cast("long").alias("n_good"), *stats(good, "good"), *stats(bad, "bad"))
