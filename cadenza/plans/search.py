"""The search for settings, all segments at once: a shared exploration, then a crf solve per target at the best AQ settings.

A measurement source is a function that adds vmaf, out_bytes and ref_bytes to proposals (segment_hash, encoder, crf, aq_mode,
aq_strength): recorded trials by an exact join, or a surface. Every round measures the proposals of all segments together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions import params as P
from cadenza.operators import records, select
from cadenza.plans import adaptive, design
from cadenza.plans.rounds import SEQ, TRIAL, Measure, dealt, grown, kept, mark, measured, rated, spread
from cadenza.sources.views import SEQ as RECORDED  # what orders recorded trials


def recorded(trials: DataFrame) -> Measure:
    """What was measured before under the same parameters (the last, of several); nulls where nothing was."""
    known = select_last(trials).select("segment_hash", "encoder", "crf", "aq_mode", "aq_strength", "vmaf", "out_bytes", "ref_bytes")
    return lambda proposals: proposals.join(known, ["segment_hash", "encoder", "crf", "aq_mode", "aq_strength"], "left")


def nearest_recorded(trials: DataFrame) -> Measure:
    """What was measured of the segment at the same AQ setting and the nearest crf (of two as near the lower); nulls where nothing was.

    A setting's points are an array, in any order: crf has one digit after the point, so a space holds a few hundred of them at most. Its attribute
    attached gives settings their points, so that the rounds of a solve, which carry them along, meet the recorded trials once and not in every round."""
    setting = {"segment_hash": "string", "encoder": "string", "aq_mode": "int", "aq_strength": "double"}
    point = F.struct("crf", "vmaf", "out_bytes", "ref_bytes")
    spread(trials)
    needed = trials.select("segment_hash", "encoder", "crf", "aq_mode", "aq_strength", "vmaf", "out_bytes", "ref_bytes", *RECORDED)
    last = select_last(dealt(needed).withColumn("__mark", mark(**setting)), ["__mark", *setting, "crf"])  # sorted so, and gathered as it lies
    known = kept(last.groupBy("__mark", *setting).agg(F.collect_list(point).alias("__points")))

    def attached(settings: DataFrame) -> DataFrame:
        return settings.withColumn("__mark", mark(**setting)).join(known, ["__mark", *setting], "left").select(*settings.columns, "__points")

    def measure(proposals: DataFrame) -> DataFrame:
        near = F.array_min(F.transform("__points", lambda p: F.struct(F.abs(p["crf"] - F.col("crf")).alias("apart"), p.alias("p"))))["p"]
        met = (proposals if "__points" in proposals.columns else attached(proposals)).withColumn("__near", F.when(F.col("crf").isNotNull(), near))
        return met.select(*proposals.columns, *[F.col(f"__near.{c}").alias(c) for c in ("vmaf", "out_bytes", "ref_bytes")])

    measure.attached = attached
    return measure


def select_last(trials: DataFrame, same: Sequence[str] = ("segment_hash", "encoder", "crf", "aq_mode", "aq_strength")) -> DataFrame:
    last = W.partitionBy(*same).orderBy(*[F.desc(c) for c in RECORDED])
    return trials.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def shifted_surface(offsets: DataFrame) -> Measure:
    """A surface per segment: its offset (segment_hash, offset) is added to the quality, and stronger AQ adds a little."""

    def measure(proposals: DataFrame) -> DataFrame:
        placed = proposals.join(offsets, "segment_hash")
        vmaf = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 110.0 - F.col("crf") + F.col("offset") + 0.2 * F.col("aq_mode") * F.col("aq_strength"))), 4)
        return placed.withColumns({"vmaf": vmaf, "out_bytes": F.greatest(F.lit(1000), F.floor(900_000 - 15_000 * F.col("crf"))).cast("bigint"), "ref_bytes": F.lit(1_000_000).cast("bigint")}).drop("offset")

    return measure


def explore(segments: DataFrame, spaces: DataFrame, measure: Measure, strategy: str = "screen", n: int = 12) -> DataFrame:
    """The shared exploration: an AQ screen, or a design of n points (grid, sobol, halton, lhs, random)."""
    if strategy == "screen":
        order = W.partitionBy("encoder").orderBy("aq_mode", "aq_strength", "crf")
        points = design.screen_plan(spaces, n).withColumn("crf", P.rounded_crf(F.col("crf"))).withColumn("seq", F.row_number().over(order))
    elif strategy == "grid":
        points = design.grid_design(spaces, n)
    else:
        points = design.sampled_design(spaces, strategy, n)
    asked = dealt(segments.select("segment_hash", "encoder")).join(F.broadcast(points), "encoder").withColumn("stage", F.lit(0))
    return measured(measure, asked)


def solve_settings(known: DataFrame, settings: DataFrame, spaces: DataFrame, targets: DataFrame, measure: Measure, method: str = "secant") -> DataFrame:
    """What is probed in search of the highest crf that meets the target at each of settings (segment_hash, target, aq_mode, aq_strength,
    and place, their order within a segment), as trials, in the order of place and probe.

    Where no known crf meets the target the least crf is probed, and that is all if even that fails; where all do, the greatest, and that
    is all if even that meets it. Then brackets are narrowed.
    """
    group = ["segment_hash", "aq_mode", "aq_strength", "target"]
    settings = settings if "place" in settings.columns else settings.withColumn("place", F.row_number().over(W.partitionBy("segment_hash").orderBy("target", "aq_mode", "aq_strength")))
    each = settings if "encoder" in settings.columns else settings.join(known.select("segment_hash", "encoder").distinct(), "segment_hash")
    # trials meet the targets that are asked of their settings, and no others
    brackets = select.crf_bracket(known.where("vmaf IS NOT NULL").join(settings.select(*group), group[:3]), SEQ)
    ends = F.broadcast(spaces.select("encoder", "crf_min", "crf_max"))
    opened = each.select(*group, "place", "encoder").join(brackets, group, "left").join(ends, "encoder")
    opened = kept(measure.attached(opened) if hasattr(measure, "attached") else opened)
    names, probes = opened.columns, []
    low, high = F.col("crf_low").isNull(), F.col("crf_high").isNull()
    meets = F.col("vmaf") >= F.col("target")
    first = kept(measure(opened.where(low).withColumn("crf", P.rounded_crf(F.col("crf_min")))))
    took = first.where(meets).withColumns({"crf_low": F.col("crf"), "vmaf_low": F.col("vmaf")}).select(*names)
    opened = opened.where(~low).unionByName(took)
    last = kept(measure(opened.where(high).withColumn("crf", P.rounded_crf(F.col("crf_max")))))
    took = last.where(~meets).withColumns({"crf_high": F.col("crf"), "vmaf_high": F.col("vmaf")}).select(*names)
    probes = design.narrow(opened.where(~high).unionByName(took), measure, method)[1]
    each = [p.where("vmaf IS NOT NULL").withColumns({"stage": F.lit(1), "seq": F.col("place") * 10 + i}).select(*TRIAL) for i, p in enumerate([first, last, *probes])]
    return reduce(DataFrame.unionAll, each)


def solve_targets(explored: DataFrame, spaces: DataFrame, targets: DataFrame, measure: Measure, n_refine: int = 2, method: str = "secant") -> DataFrame:
    """For each target, in order, the crf solve at the n_refine AQ settings that rank best by all trials so far: explored with the probes of
    target i as stage i (from 1), so that a later target goes on from what was probed for an earlier one."""
    trials = explored
    for i, row in enumerate(targets.orderBy("target").collect(), start=1):  # a handful
        one = targets.where(F.col("target") == row["target"])
        best = kept(select.rank_aq(rated(trials, one), n_refine, SEQ).withColumnRenamed("rank", "place"))
        trials = grown(trials, solve_settings(trials, best, spaces, one, measure, method).withColumn("stage", F.lit(i)))
    return trials


def trials_of(segments: DataFrame, spaces: DataFrame, targets: DataFrame, measure: Measure, strategy: str = "screen", n: int = 12, n_refine: int = 2, method: str = "secant") -> DataFrame:
    """All trials of a search, in the order of stage and seq.

    strategy: screen, grid, sobol, halton, lhs, random, bayes, tpe or cmaes, which explore and then solve the n_refine best settings, or
    coordinate or boundary, which screen and then walk. The models explore for the lowest target.
    """
    if strategy in adaptive.WALKS:
        solve = lambda trials, settings: solve_settings(trials, settings, spaces, targets, measure, method)
        return adaptive.WALKS[strategy](explore(segments, spaces, measure, "screen", n), spaces, targets, measure, solve)
    if strategy in adaptive.MODELS:
        explored = adaptive.explore(segments, spaces, measure, strategy, targets.agg(F.min("target")).first()[0], n)
    else:
        explored = explore(segments, spaces, measure, strategy, n)
    return solve_targets(explored, spaces, targets, measure, n_refine, method)


def at_target(trials: DataFrame, targets: DataFrame, in_turn: bool = True) -> DataFrame:
    """Rated trials against every target. in_turn: those that there were when the target's turn was over (stage i is the i-th target's)."""
    r = rated(trials, targets)
    if not in_turn:
        return r
    turns = F.broadcast(targets.select("target", F.row_number().over(W.orderBy("target")).alias("turn")))  # a handful
    return r.join(turns, "target").where("stage <= turn").drop("turn")


def search(segments: DataFrame, spaces: DataFrame, targets: DataFrame, measure: Measure, strategy: str = "screen", n: int = 12, n_refine: int = 2) -> DataFrame:
    """The best trial of each segment and target, or the one of highest quality where none is feasible, of trials_of."""
    trials = trials_of(segments, spaces, targets, measure, strategy, n, n_refine)
    r = at_target(trials, targets, strategy not in adaptive.WALKS)
    return select.best_or_closest(r, SEQ).select("segment_hash", "target", "feasible", "crf", "aq_mode", "aq_strength", "vmaf", F.round("score", 6).alias("score"))


def results(trials: DataFrame, targets: DataFrame, k: int = select.TOP_K, in_turn: bool = True) -> DataFrame:
    """A row per segment and target: the best trial, the k best feasible ones, how many trials there were by then (probes of every solve
    among them) and how many of them differ, each of which was measured once."""
    r = at_target(trials, targets, in_turn).withColumn("source", F.lit(None).cast("string"))
    found = records.results(r, k, SEQ).drop("source")
    encodes = r.groupBy("segment_hash", "target").agg(F.countDistinct("crf", "aq_mode", "aq_strength").alias("n_encodes"))
    return found.join(encodes, ["segment_hash", "target"])
