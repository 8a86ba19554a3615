"""The registered queries of the engine: each applies operators to whole derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions import params as P
from cadenza.functions import scoring, text
from cadenza.operators import features as feat
from cadenza.operators import modeling, segments, select, store, training
from cadenza.plans import design, workflow
from cadenza.plans import search as searching
from cadenza.sources import media, views
from cadenza.sources.views import SEQ
from cadenza.streaming import progress as prog

C = F.col


def trial_score(spark: SparkSession, sf: str) -> DataFrame:
    r = scoring.with_score(views.rated(spark, sf))
    return r.select("segment_hash", *SEQ, "target", F.round("score", 6).alias("score"), F.round("proxy", 9).alias("proxy"), F.round("compression", 6).alias("compression"), F.round("quality", 6).alias("quality"))


def score_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Each trial's reason, and how many trials of the target have the same."""
    return views.rated(spark, sf).select("target", scoring.reason(C("vmaf"), C("rate"), C("target")).alias("reason")).groupBy("target", "reason").agg(F.count(F.lit(1)).alias("n"))


def feasible_trials(spark: SparkSession, sf: str) -> DataFrame:
    return views.rated(spark, sf).where(scoring.feasible(C("vmaf"), C("rate"), C("target"))).select("segment_hash", "target", *SEQ, "vmaf", F.round("rate", 9).alias("rate"))


def top_trials(spark: SparkSession, sf: str) -> DataFrame:
    return select.top_trials(views.rated(spark, sf)).select("segment_hash", "target", C("rank").cast("int").alias("rank"), "crf", "aq_mode", "aq_strength", "vmaf", F.round("score", 6).alias("score"))


def best_or_closest(spark: SparkSession, sf: str) -> DataFrame:
    return select.best_or_closest(views.rated(spark, sf, True)).select("segment_hash", "target", "feasible", "crf", "aq_mode", "aq_strength", "vmaf", F.round("score", 6).alias("score"))


def best_aq(spark: SparkSession, sf: str) -> DataFrame:
    return select.best_aq(views.rated(spark, sf, True)).select("segment_hash", "target", "aq_mode", "aq_strength", F.round("proxy", 9).alias("value"))


def rank_aq(spark: SparkSession, sf: str) -> DataFrame:
    return select.rank_aq(views.rated(spark, sf, True)).select("segment_hash", "target", "aq_mode", "aq_strength", F.round("value", 9).alias("value"), C("rank").cast("int").alias("rank"))


def refine_aq(spark: SparkSession, sf: str) -> DataFrame:
    return select.rank_aq(views.rated(spark, sf, True), 2).groupBy("target", "aq_mode", "aq_strength").agg(F.count(F.lit(1)).alias("n_segments"))


def crf_bracket(spark: SparkSession, sf: str) -> DataFrame:
    return select.crf_bracket(views.rated(spark, sf, True))


def crf_guess(spark: SparkSession, sf: str) -> DataFrame:
    b = select.crf_bracket(views.rated(spark, sf, True))
    golden = select.clamped_guess(b, "golden").select("segment_hash", "aq_mode", "aq_strength", "target", F.round("guess", 6).alias("golden"))
    return select.clamped_guess(b).select("segment_hash", "aq_mode", "aq_strength", "target", F.round("guess", 6).alias("secant")).join(golden, ["segment_hash", "aq_mode", "aq_strength", "target"])


def iq_guess(spark: SparkSession, sf: str) -> DataFrame:
    """A crf from the last three trials of every segment."""
    order = W.partitionBy("segment_hash", "target").orderBy(*[F.desc(c) for c in SEQ])
    r = views.rated(spark, sf, True).withColumn("n", F.row_number().over(order)).where("n <= 3")
    h = r.groupBy("segment_hash", "target").agg(F.array_sort(F.collect_list(F.struct((-C("n")).alias("n"), "crf", "vmaf"))).alias("h"))
    return h.select("segment_hash", "target", F.round(select.inverse_quadratic(C("h"), C("target")), 4).alias("guess"))


def crf_solve(spark: SparkSession, sf: str) -> DataFrame:
    """Every bracket narrowed by the segment's recorded trials."""
    return workflow.solved(spark, sf, "secant")


def explored_range(spark: SparkSession, sf: str) -> DataFrame:
    return select.explored_range(views.rated(spark, sf))


def tpe_split(spark: SparkSession, sf: str) -> DataFrame:
    return select.good_bad(views.rated(spark, sf, True)).select("segment_hash", "target", "n_good", *[F.round(c, 6).alias(c) for c in ("good_mean", "good_std", "bad_mean", "bad_std")])


def _with_space(spark: SparkSession, sf: str) -> DataFrame:
    shifted = views.trials(spark, sf).select(*SEQ, (C("crf") * 1.5 - 10).alias("crf"), (C("l_suppkey") % 7 - 1).cast("int").alias("aq_mode"), (C("aq_strength") * 2.25 - 2).alias("aq_strength"))
    return shifted.crossJoin(F.broadcast(views.spaces(spark)))  # six rows


def clamped_params(spark: SparkSession, sf: str) -> DataFrame:
    c = P.clamp(C("crf"), C("aq_mode"), C("aq_strength"), P.space_columns())
    return _with_space(spark, sf).select("encoder", *SEQ, *[v.alias(k) for k, v in c.items()])


def unit_cube(spark: SparkSession, sf: str) -> DataFrame:
    s = P.space_columns()
    c = _with_space(spark, sf).select("encoder", *s, *SEQ, *[v.alias(f"c_{k}") for k, v in P.clamp(C("crf"), C("aq_mode"), C("aq_strength"), s).items()])
    u = P.to_unit(C("c_crf"), C("c_aq_mode"), C("c_aq_strength"), s)
    placed = c.select("*", *[P.quickly(F.round, v, 9).alias(k) for k, v in u.items()])
    back = P.from_unit(C("crf_u"), C("mode_u"), C("strength_u"), s)
    return placed.select("encoder", *SEQ, "crf_u", "mode_u", "strength_u", *[v.alias(k) for k, v in back.items()])


def trial_keys(spark: SparkSession, sf: str) -> DataFrame:
    return views.trials(spark, sf).select(*SEQ, store.key().alias("key"))


def aq_grid(spark: SparkSession, sf: str) -> DataFrame:
    """How often the segments' trials use each setting of each encoder's grid."""
    used = views.trials(spark, sf).groupBy("aq_mode", "aq_strength").agg(F.count(F.lit(1)).alias("n_trials"))
    return design.aq_grid(views.spaces(spark)).join(used, ["aq_mode", "aq_strength"], "left").select("encoder", C("seq").cast("int").alias("seq"), "aq_mode", "aq_strength", F.coalesce("n_trials", F.lit(0)).cast("bigint").alias("n_trials"))


def aq_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """For the best setting of every segment and target its neighbours on the encoder's grid."""
    near = design.aq_neighbours(design.aq_grid(views.spaces(spark).where("encoder = 'libsvtav1'"))).drop("encoder")
    return select.best_aq(views.rated(spark, sf, True)).select("segment_hash", "target", "aq_mode", "aq_strength").join(F.broadcast(near), ["aq_mode", "aq_strength"])


def screen_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The screen of every segment: settings by crf probes, with how many trials there are at that setting."""
    plan = design.screen_plan(views.spaces(spark).where("encoder = 'libsvtav1'")).drop("encoder")
    per = views.trials(spark, sf).groupBy("segment_hash", "aq_mode", "aq_strength").agg(F.count(F.lit(1)).alias("n_trials"))
    return per.join(F.broadcast(plan), ["aq_mode", "aq_strength"]).select("segment_hash", "aq_mode", "aq_strength", F.round("crf", 6).alias("crf"), "n_trials")


def grid_design(spark: SparkSession, sf: str) -> DataFrame:
    """The grid design of every segment's encoder, anti-joined with the trials that exist."""
    grid = design.grid_design(views.spaces(spark), 16)
    segments_ = views.trials(spark, sf).select("segment_hash", "encoder").distinct()
    known = views.trials(spark, sf).select("segment_hash", "encoder", "crf", "aq_mode", "aq_strength").distinct()
    return segments_.join(F.broadcast(grid), "encoder").join(known, ["segment_hash", "encoder", "crf", "aq_mode", "aq_strength"], "left_anti").select("segment_hash", "crf", "aq_mode", "aq_strength", C("seq").cast("int").alias("seq"))


def _sampled(method: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        points = design.sampled_design(views.spaces(spark), method, 16)
        found = views.trials(spark, sf).select("segment_hash", "encoder").distinct().join(F.broadcast(points), "encoder")
        return searching.nearest_recorded(views.trials(spark, sf))(found)

    query.__name__ = f"sampler_{method}"
    return query


def boundary_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = segments.boundary_plan(views.cuts(spark, sf))
    return plan.select("source", F.size("kept").cast("bigint").alias("n_kept"), F.array_join(F.transform("kept", lambda x: x.cast("int").cast("string")), ",").alias("kept"))


def boundary_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return segments.pieces(segments.boundary_plan(views.cuts(spark, sf)))


def segment_starts(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segment_starts(segments.pieces(segments.boundary_plan(views.cuts(spark, sf))))


def boundary_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The boundaries of every source by blocks of its time, a row each."""
    return segments.boundary_rows(*views.cut_rows(spark, sf), width=96.0)


def segment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The segments of every source by blocks of its time."""
    sources = views.cut_rows(spark, sf)[1]
    return segments.segment_rows(boundary_rows(spark, sf), sources, width=96.0)


def concat_lists(spark: SparkSession, sf: str) -> DataFrame:
    return segments.concat_list(segment_starts(spark, sf))


def frame_motion(spark: SparkSession, sf: str) -> DataFrame:
    m = feat.motion(views.frames(spark, sf))
    return m.select("clip", "n_frames", *[F.round(c, 9).alias(c) for c in ("motion_mean", "motion_p95", "luma_mean", "luma_std")])


def frame_entropy(spark: SparkSession, sf: str) -> DataFrame:
    chars = views.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return feat.entropy(chars, "doc_id", "ch").select("doc_id", F.round("entropy", 6).alias("entropy"))


def frame_sample(spark: SparkSession, sf: str) -> DataFrame:
    return feat.sampled(views.frames(spark, sf), 12).select("clip", C("place").cast("int").alias("place"), "frame")


def frame_count_check(spark: SparkSession, sf: str) -> DataFrame:
    per = views.trials(spark, sf).groupBy("segment_hash").agg(F.count(F.lit(1)).alias("scored"), (F.countDistinct("crf") * 2 + 3).alias("frames"))
    return per.select("segment_hash", "scored", "frames", feat.expected_frames(C("frames"), 2).alias("expected"), feat.count_trusted(C("scored"), C("frames"), 2).alias("trusted"))


def pooled_quality(spark: SparkSession, sf: str) -> DataFrame:
    p = feat.pooled(views.trials(spark, sf), "segment_hash", "vmaf")
    return p.select("segment_hash", F.round("mean", 9).alias("mean"), F.round("harmonic", 9).alias("harmonic"), "least", "n_scores")


def _done(spark: SparkSession, sf: str) -> DataFrame:
    return views.trials(spark, sf).where("l_partkey % 3 = 0").select("segment_hash").distinct()


def pending_segments(spark: SparkSession, sf: str) -> DataFrame:
    return store.pending(views.trials(spark, sf).select("segment_hash", "source").distinct(), _done(spark, sf))


def reused_sources(spark: SparkSession, sf: str) -> DataFrame:
    all_ = views.trials(spark, sf).select("segment_hash", "source").distinct()
    kept = store.reused(all_.select("source").distinct(), all_, _done(spark, sf)).withColumn("state", F.lit("reused"))
    fresh = all_.select("source").distinct().join(kept, "source", "left_anti").withColumn("state", F.lit("new"))
    return kept.unionByName(fresh)


def trial_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return store.upsert(views.trials(spark, sf), list(SEQ)).select("key", *SEQ, "vmaf", "out_bytes")


def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    known = store.upsert(views.trials(spark, sf).where("l_orderkey % 2 = 0"), list(SEQ))
    return store.lookup(views.trials(spark, sf), known).groupBy("segment_hash").agg(F.count_if("hit").alias("hits"), F.count_if(~C("hit")).alias("misses"), F.max("stored_vmaf").alias("best_stored"))


def corpus_progress(spark: SparkSession, sf: str) -> DataFrame:
    r = views.rated(spark, sf).withColumn("ok", scoring.feasible(C("vmaf"), C("rate"), C("target")))
    per = r.groupBy("source", "segment_hash", "target").agg(F.max("ok").alias("ok"))
    bad = F.count_if(~C("ok"))
    return per.groupBy("source").agg(F.countDistinct("segment_hash").alias("n_segments"), F.count(F.lit(1)).alias("n_rows"), bad.alias("n_infeasible"), F.round(100.0 * bad / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("percent"))


def feature_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return modeling.ranges(views.features(spark, sf))


def domain_violations(spark: SparkSession, sf: str) -> DataFrame:
    f = views.features(spark, sf)
    return modeling.violations(f, modeling.ranges(f.where("source IN ('src_1', 'src_2', 'src_3')")))


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = modeling.regression_metrics(workflow.left_out(spark, sf), "target", C("crf"), C("predicted"))
    return m.select("target", "n", *[F.round(c, 6).alias(c) for c in ("mae", "bias", "r2", "hit_rate", "overshoot_p90")])


def mode_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return modeling.accuracy(workflow.left_out(spark, sf), "target", C("aq_mode"), C("mode_predicted")).select("target", F.round("accuracy", 6).alias("accuracy"))


def grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    return modeling.grouped_split(views.features(spark, sf)).select("segment_hash", "source", "validation")


def model_predict(spark: SparkSession, sf: str) -> DataFrame:
    """What the bundle of each target says for every segment."""
    bundles = training.train_all(workflow.kept(training.needed(workflow.search_rows(spark, sf))), "libsvtav1")
    asked = workflow.kept(views.features(spark, sf)).crossJoin(F.broadcast(views.spaces(spark).where("encoder = 'libsvtav1'")))  # one row
    said = [training.predict(asked, b, P.space_columns()).select("segment_hash", F.lit(t).alias("target"), "crf", "aq_mode", "aq_strength") for t, b in bundles.items()]
    return reduce(DataFrame.unionAll, said)


def probe_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = media.media_info(views.probes(spark, sf))
    return m.select("page_id", "width", "height", F.round("fps", 6).alias("fps"), "duration", "n_frames", "codec", "pix_fmt", F.round("bitrate_kbps", 6).alias("bitrate_kbps"), "size_bytes", "has_audio")


def pixfmt_resolve(spark: SparkSession, sf: str) -> DataFrame:
    m = media.media_info(views.probes(spark, sf))
    supported = F.when(C("page_id") % 4 == 0, F.array(F.lit("yuv420p"), F.lit("yuv420p10le"))).when(C("page_id") % 4 == 1, F.array(F.lit("nv12"), F.lit("gray"))).when(C("page_id") % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("yuv444p"), F.lit("yuv420p")))
    asked = F.when(C("page_id") % 11 == 0, "yuv422p").otherwise("auto")
    return m.select("page_id", text.pixel_format(asked, C("pix_fmt"), supported).alias("chosen"))


def encode_arguments(spark: SparkSession, sf: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(k) for k in text.PRESETS]), (C("page_id") % 10 + 1).cast("int"))
    m = media.media_info(views.probes(spark, sf)).withColumn("preset", F.when(C("page_id") % 3 == 0, (C("page_id") % 16 - 2).cast("string")).otherwise(names))
    key = text.keyint(C("fps"), F.lit(2.0))
    return m.select("page_id", F.concat(F.lit("keyint="), key.cast("string"), F.lit(":preset="), text.preset_number(C("preset")).cast("string")).alias("arguments"), text.container(F.when(C("page_id") % 2 == 0, "libsvtav1").otherwise("libx265")).alias("container"), text.escape_filter_path(F.concat(F.lit("C:/it's/["), C("page_id").cast("string"), F.lit("]"))).alias("escaped"))


def tool_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Listings made of each conversation: its turns, a rule after the first."""
    rows = views.table(spark, sf, "conversations").select(C("conv_id").alias("doc"), C("turn").alias("pos"), F.when(C("turn") == 0, " ------").otherwise(F.concat(F.lit(" V..... "), C("role"), F.lit("_"), C("turn").cast("string"), F.lit("  text"))).alias("line"))
    return media.listing(rows, 1)


def progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    return prog.counts(prog.progress(views.table(spark, sf, "events")))


def _searched(strategy: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        """Searches every segment; what is proposed is measured by the segment's recorded trials."""
        t = views.trials(spark, sf)
        return searching.search(t.select("segment_hash", "encoder").distinct(), views.spaces(spark), views.targets(spark), searching.nearest_recorded(t), strategy)

    query.__name__ = f"search_{strategy}"
    return query


def bundle_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles as the orders' clerks would have trained them, looked up for every encoder and target that the trials need."""
    trained = views.trials(spark, sf).groupBy(F.concat(F.lit("lib"), (C("l_suppkey") % 5).cast("string")).alias("encoder"), F.when(C("l_linenumber") % 4 > 0, 80.0 + C("l_linenumber") * 4).alias("target")).agg(F.min("vmaf").alias("low"), F.lit(92.0).alias("high"))
    path = F.concat_ws("/", F.lit("models"), "encoder", F.coalesce(F.concat(F.lit("target_"), P.short(C("target"))), F.lit("all")))
    known = media.bundles(trained.withColumn("path", path).withColumn("heads", F.when(C("encoder") == "lib3", F.array(F.lit("crf"))).otherwise(F.array(F.lit("crf"), F.lit("aq_mode"), F.lit("aq_strength")))))
    asked = views.trials(spark, sf).select(F.concat(F.lit("lib"), (C("l_suppkey") % 5).cast("string")).alias("encoder")).distinct().crossJoin(F.broadcast(views.targets(spark).union(spark.range(1).select(F.lit(84.0)))))
    return media.find_bundle(asked, known)


def quality_logs(spark: SparkSession, sf: str) -> DataFrame:
    frame = F.struct(C("n").alias("frameNum"), F.struct("vmaf").alias("metrics"))
    rows = views.trials(spark, sf).withColumn("n", F.row_number().over(W.partitionBy("segment_hash").orderBy(*SEQ)))
    pooled = F.struct(F.struct(F.avg("vmaf").alias("mean"), (F.count("vmaf") / F.sum(1.0 / C("vmaf"))).alias("harmonic_mean"), F.min("vmaf").alias("min")).alias("vmaf"))
    logs = rows.groupBy("segment_hash").agg(F.to_json(F.struct(F.array_sort(F.collect_list(frame)).alias("frames"), pooled.alias("pooled_metrics"))).alias("log"))
    q = media.quality_rows(logs)
    return q.select("segment_hash", "n_frames", F.round("mean", 6).alias("mean"), F.round("harmonic", 6).alias("harmonic"), "least", "plausible")


def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A line of text for each segment's result at each target."""
    b = select.best_or_closest(views.rated(spark, sf, True))
    met = F.when(C("feasible"), "MET").otherwise("MISSED")
    line = F.concat(C("segment_hash"), F.lit(" target "), P.short(C("target")), F.lit(": "), store.params_key(C("crf"), C("aq_mode"), C("aq_strength")), F.format_string(" vmaf=%.2f out=%.4f MB [", "vmaf", C("out_bytes") / F.lit(1e6)), met, F.lit("]"))
    return b.select("segment_hash", "target", line.alias("line"))


ALL = (
    trial_score, score_reason, feasible_trials, top_trials, best_or_closest, best_aq, rank_aq, refine_aq, crf_bracket, crf_guess, iq_guess, crf_solve, explored_range, tpe_split, clamped_params, unit_cube, trial_keys, aq_grid, aq_neighbors, screen_plan, grid_design,
    *map(_sampled, ("sobol", "halton", "lhs", "random")), boundary_plan, boundary_pieces, segment_starts, boundary_rows, segment_rows, concat_lists, frame_motion, frame_entropy, frame_sample, frame_count_check, pooled_quality, pending_segments, reused_sources, trial_upsert, cache_lookup, corpus_progress,
    feature_ranges, domain_violations, regression_metrics, mode_accuracy, grouped_split, model_predict, probe_rows, pixfmt_resolve, encode_arguments, tool_listing, progress_counts, *map(_searched, ("screen", "halton", "sobol", "coordinate", "boundary", "bayes", "tpe", "cmaes")), bundle_lookup, quality_logs, result_summary, *workflow.ALL,
)
QUERIES = {q.__name__: q for q in ALL}
