"""Registered queries around a run: manifests, records and datasets, models, plans of one video, argument lists, scene features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions import arguments
from cadenza.functions import params as P
from cadenza.functions.text import pixel_format
from cadenza.operators import features as feat
from cadenza.operators import modeling, pictures, records, segments, select, store, training, trialstore
from cadenza.plans import design
from cadenza.plans import search as searching
from cadenza.plans.rounds import dealt, kept, parts, rate
from cadenza.sources import commitlog, manifests, media, views
from cadenza.sources.views import FEATURES, SEQ

C = F.col
TARGETS = views.TARGETS


def search_records(spark: SparkSession, sf: str) -> DataFrame:
    return records.nested(records.results(views.rated(spark, sf, True)), views.features(spark, sf))


def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    return records.dataset_rows(search_records(spark, sf))


def dataset_rows(spark: SparkSession, sf: str) -> DataFrame:
    return search_rows(spark, sf).select(*records.COLUMNS)


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    return records.dataset_rows(search_records(spark, sf)).select("source", "segment_hash", "target", "rank", "vmaf", "rate", "ratio", "score", "encoder", "n_trials", *records.LABELS)


def infeasible_share(spark: SparkSession, sf: str) -> DataFrame:
    """Results without a feasible trial, which records keep, against the rows that a dataset gets."""
    r = search_records(spark, sf)
    rows = records.dataset_rows(r).groupBy("encoder").agg(F.count(F.lit(1)).alias("n_rows"))
    return records.infeasible(r).join(rows, "encoder").withColumn("percent", F.round(100.0 * C("n_infeasible") / F.greatest(F.lit(1), C("n_rows")), 6))


def latest_records(spark: SparkSession, sf: str) -> DataFrame:
    """A checkpoint of files: a batch with every segment's record, cut off for every fifth, then one with those of every second segment
    once more, with another source; the files of a third append, which died before its commit, do not count."""
    r = search_records(spark, sf)
    lines = r.select(F.substring("segment_hash", 5, 20).cast("bigint").alias("k"), F.to_json(F.struct(*r.columns)).alias("value"))
    path = commitlog.scratch(spark, "checkpoint")
    commitlog.append(lines.select("value"), f"{path}-made")  # worked out once, for three writers
    lines = commitlog.lines(spark, f"{path}-made").select(F.get_json_object("line", "$.segment_hash").alias("h"), C("line").alias("value")).select(F.substring("h", 5, 20).cast("bigint").alias("k"), "value")
    commitlog.append(lines.select(F.when(C("k") % 5 == 0, F.substring("value", 1, 60)).otherwise(C("value")).alias("value")), path)
    again = lambda name: lines.where("k % 2 = 0").select(F.replace("value", F.lit('"source":"src_'), F.lit(f'"source":"{name}_')).alias("value"))
    commitlog.append(again("again"), path)
    commitlog.written(again("lost"), path)
    full = store.latest_records(store.read_checkpoint(spark, path), "libsvtav1", list(TARGETS))
    pos = 2 * F.substring("segment_hash", 5, 20).cast("bigint") + C("pos.batch")
    return full.select(pos.alias("pos"), "segment_hash", "source", F.size(F.map_keys("results")).cast("bigint").alias("n_targets"), F.size(F.map_keys("features")).cast("bigint").alias("n_features"))


def design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Features and labels of target 89, and of all targets with the target as a feature, from dataset rows as text."""
    rows = dataset_rows(spark, sf)
    text = rows.select(*[C(c).cast("string").alias(c) for c in rows.columns])
    one = training.design_matrix(text, 89.0).withColumn("vmaf_target", F.lit(0.0))
    every = training.design_matrix(text, with_target=True)
    cells = [*FEATURES, training.TARGET_FEATURE, *records.LABELS]
    total = lambda df, name: df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 2).alias(c) for c in cells]).withColumn("model", F.lit(name))
    return total(one, "target_89").unionByName(total(every, "all"))


def training_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Per target the rows, distinct segments and sources (in order) that a model of it is trained on."""
    return dataset_rows(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("segment_hash").alias("n_segments"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Per source how many of its segments were searched, and whether all were."""
    t = views.trials(spark, sf)
    done = t.where("l_partkey % 3 > 0 OR l_partkey % 20 < 5").select("segment_hash").distinct().withColumn("done", F.lit(True))
    per = t.select("source", "segment_hash").distinct().join(done, "segment_hash", "left").groupBy("source")
    return per.agg(F.count(F.lit(1)).alias("expected"), F.count("done").alias("searched")).withColumn("complete", C("expected") == C("searched"))


def train_models(spark: SparkSession, sf: str) -> DataFrame:
    """Trains a bundle for each target and one for all: what each is worth on sources held out, by the numbers of its metadata."""
    bundles = training.train_all(kept(training.needed(search_rows(spark, sf))), "libsvtav1", unified=True)
    said = [("all" if t is None else f"target_{t:g}", b.metadata["n_train"], b.metadata["n_val"], k, float(v)) for t, b in bundles.items() for k, v in b.metadata["metrics"].items()]
    return spark.createDataFrame(said, "model string, n_train long, n_val long, metric string, value double")


def metadata_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of a bundle per target, written as JSON and read again: the ranges of its features, and what else it says."""
    rows = dataset_rows(spark, sf)
    ends = rows.groupBy("target").agg(F.count(F.lit(1)).alias("n_train"), *[F.array(F.min(c), F.max(c)).alias(c) for c in FEATURES])
    ranges_ = F.create_map(*[x for c in FEATURES for x in (F.lit(c), C(c))])
    said = manifests.metadata_json({"schema_version": F.lit(manifests.FOR_TARGET), "encoder": F.lit("libsvtav1"), "target": C("target"), "feature_names": F.array(*map(F.lit, FEATURES)), "n_train": C("n_train"), "training_targets": F.array("target"), "feature_ranges": ranges_})
    broken = ends.select(F.lit('{"schema_version": 7}').alias("document")).union(ends.select(F.lit("{none")))
    read = manifests.metadata(ends.select(said.alias("document")).union(broken))
    return read.select("target", "n_train", F.size("feature_names").alias("n_features"), F.explode("feature_ranges").alias("feature", "r")).select("target", "n_train", "n_features", "feature", C("r")[0].alias("low"), C("r")[1].alias("high"))


def package_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A package document for the encoder, with the share of segments that each target's bundle serves."""
    ok = select.best_or_closest(views.rated(spark, sf, True)).groupBy("encoder", "target").agg(F.round(F.avg(C("feasible").cast("double")), 4).alias("hit_rate"))
    return manifests.package_manifest(ok.withColumn("path", F.concat_ws("/", "encoder", F.concat(F.lit("target_"), P.short(C("target"))))))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = search_records(spark, sf)
    return manifests.run_summary(r, records.dataset_rows(r), TARGETS)


def _manifest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Per source a manifest of its segments, some items broken, one document no array; and the files that exist."""
    per = views.trials(spark, sf).select("source", C("l_partkey").alias("k")).distinct()
    item = F.to_json(F.struct(C("k").cast("string").alias("index"), F.concat(F.lit("cut/"), C("k").cast("string")).alias("path"), "source", F.when(C("k") % 11 == 0, "soon").otherwise((C("k") * 0.5).cast("string")).alias("start"), F.when(C("k") % 7 > 0, F.lit(6.25)).alias("duration")))
    docs = per.groupBy("source").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]")).alias("manifest")).select(C("source").alias("doc"), "manifest")
    docs = docs.withColumn("manifest", F.when(C("doc") == "src_9", F.lit("{not an array")).otherwise(C("manifest")))
    files = per.where("k % 5 > 0 OR source IN ('src_1', 'src_2')").select(F.concat(F.lit("cut/"), C("k").cast("string")).alias("path"))
    return docs, files


def segment_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What a resumed run reuses of the manifests, and the sources that it has to cut anew."""
    docs, files = _manifest(spark, sf)
    sources = views.trials(spark, sf).select("source").where("source <> 'src_3'").distinct()
    reused = manifests.resumed(sources, manifests.segment_rows(docs), files)
    new = manifests.to_cut(sources, reused)
    return reused.select("source", "path", "index", "start").unionByName(new.select("source", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("index"), F.lit(None).cast("double").alias("start")))


def complete_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """The segments of the sources of which no file is missing."""
    docs, files = _manifest(spark, sf)
    return manifests.complete(manifests.segment_rows(docs), files).select("source", "path", "index", "duration")


def _text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two lines for each page: one that a careless reader would take for a count, or nothing; and the count, or a list of formats."""
    p = views.table(spark, sf, "pages").select(C("page_id").alias("doc"))
    first = F.when(C("doc") % 3 == 0, F.concat(F.lit("n "), C("doc").cast("string"))).when(C("doc") % 3 == 1, "").otherwise("  12x,")
    second = F.when(C("doc") % 5 == 0, "none").otherwise(F.concat(F.lit(" "), (C("doc") + 7).cast("string"), F.when(C("doc") % 2 == 0, ",,").otherwise("")))
    return p.select("doc", F.posexplode(F.array(first, second)).alias("pos", "line"))


def frame_counts(spark: SparkSession, sf: str) -> DataFrame:
    return media.frame_count(_text_lines(spark, sf))


def listed_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats out of help texts, and what each page's source is encoded with given them."""
    m = media.media_info(views.probes(spark, sf)).select(C("page_id").alias("doc"), "pix_fmt")
    listed = F.when(C("doc") % 4 == 0, "    Supported pixel formats: yuv420p yuv420p10le").when(C("doc") % 4 == 1, "  Supported pixel formats:  nv12 gray nv12 ").when(C("doc") % 4 == 2, "Threading capabilities: frame").otherwise("Supported pixel formats:")
    lines = m.select("doc", F.posexplode(F.array(F.lit("Encoder x [x]:"), listed, F.lit("Supported pixel formats: late"))).alias("pos", "line")).where("NOT (pos = 2 AND doc % 4 = 2)")
    known = media.supported_formats(lines)
    return m.join(known, "doc").withColumn("chosen", pixel_format(F.lit("auto"), C("pix_fmt"), C("formats"))).select("doc", F.array_join("formats", " ").alias("formats"), "chosen")


def encode_argv(spark: SparkSession, sf: str) -> DataFrame:
    """The argument list of every page's encode, the encoders in turn."""
    m = media.media_info(views.probes(spark, sf)).withColumn("encoder", F.element_at(F.array(*[F.lit(s[0]) for s in views.SPACES]), (C("page_id") % 6 + 1).cast("int")))
    m = m.join(F.broadcast(views.spaces(spark)), "encoder")  # six rows
    request = {
        "program": F.lit("ffmpeg"), "input": F.concat(F.lit("in/"), C("page_id").cast("string")), "output": F.lit("out.mkv"), "pix_fmt": C("pix_fmt"), "preset": F.when(C("page_id") % 12 < 6, F.lit("slow")).otherwise(F.lit("fast")),
        "crf": 15.0 + C("page_id") % 50, "aq_mode": (C("page_id") % 3).cast("int"), "aq_strength": (C("page_id") % 9) * 0.25, "fps": C("fps"), "seconds": F.lit(2.0), "threads": (C("page_id") % 5).cast("int"), "loglevel": F.lit("error"), "extra": F.when(C("page_id") % 4 == 0, F.array(F.lit("-tag:v"), F.concat(F.lit("t"), C("page_id").cast("string")))),
    }
    made = F.coalesce(*[F.when(C("encoder") == s[0], arguments.argv(s[0], request, P.space_columns())) for s in views.SPACES])
    return m.select("page_id", "encoder", F.array_join(made, " ").alias("argv"))


def space_guesses(spark: SparkSession, sf: str) -> DataFrame:
    """For every encoder's space its document, its middle, and what is tried after trials of each crf fail; levels with their targets."""
    s = P.space_columns()
    crfs = views.trials(spark, sf).groupBy((F.floor(C("crf") / 5) * 5.0).alias("failed")).agg(F.count(F.lit(1)).alias("n_trials"))
    m, again = P.midpoint(s), P.safe(C("failed"), s)
    placed = crfs.crossJoin(F.broadcast(views.spaces(spark)))  # six rows
    return placed.select("encoder", "failed", "n_trials", P.space_json(s).alias("space"), P.params_key(m["crf"], m["aq_mode"], m["aq_strength"]).alias("middle"), P.params_key(again["crf"], again["aq_mode"], again["aq_strength"]).alias("again"), P.level_target(F.floor(C("failed") / 10).cast("int")).alias("level_target"))


def video_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The plan of every source: its segments, what was probed of them and what was predicted for them, side by side by number."""
    cut = segments.segment_starts(segments.pieces(segments.boundary_plan(views.cuts(spark, sf))))
    infos = cut.select("source", "idx", (24.0 + C("idx") % 3 * 3).alias("fps"))
    guesses = cut.select("source", "idx", (10.0 + C("idx") * 1.37 % 60).alias("crf"), (C("idx") % 4).cast("int").alias("aq_mode"), (C("idx") % 7 * 0.8).alias("aq_strength"))
    whole = segments.side_by_side(cut, {"infos": infos, "guesses": guesses})
    placed = whole.crossJoin(F.broadcast(views.spaces(spark).where("encoder = 'libsvtav1'")))  # one row
    c = P.clamp(C("crf"), C("aq_mode"), C("aq_strength"), P.space_columns())
    again = P.safe(c["crf"], P.space_columns())
    return placed.select("source", "idx", "start", "duration", "fps", *[v.alias(k) for k, v in c.items()], again["crf"].alias("retry_crf"))


def fallback_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces where every third source has no scene cut at all and so gets even ones."""
    cuts = views.cuts(spark, sf).withColumn("cuts", F.when(C("source") % 3 == 0, F.array().cast("array<double>")).otherwise(C("cuts")))
    return segments.pieces(segments.boundary_plan(cuts))


def record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line of text for every segment's record, all its targets, and one for the training report of each target."""
    r = search_records(spark, sf)
    each = F.transform(F.map_entries("results"), lambda e: F.concat(F.lit("t"), e["key"], F.when(e["value"]["feasible"], F.lit(" ok")).otherwise(F.lit(" infeasible")), F.format_string(" vmaf=%.2f", e["value"]["vmaf"]), F.lit(" crf="), P.short(e["value"]["params"]["crf"]), F.lit(" aq="), e["value"]["params"]["aq_mode"].cast("string"), F.lit("/"), P.short(e["value"]["params"]["aq_strength"]), F.lit(" trials="), e["value"]["n_trials"].cast("string")))
    said = r.select("segment_hash", F.when(F.size("results") > 0, F.array_join(each, "; ")).otherwise("no results").alias("line"))
    m = modeling.regression_metrics(left_out(spark, sf), "target", C("crf"), C("predicted"))
    report = m.select(F.concat(F.lit("report "), P.short(C("target"))).alias("segment_hash"), F.concat(F.lit("target "), P.short(C("target")), F.lit(" train="), C("n").cast("string"), F.format_string(" crf MAE=%.2f", F.round("mae", 2)), F.lit(" hit-rate="), F.bround(C("hit_rate") * 100, 0).cast("int").cast("string"), F.lit("%")).alias("line"))
    return said.unionByName(report)


def left_out(spark: SparkSession, sf: str) -> DataFrame:
    """The best trials with what the other segments of the source say for the target: their mean crf (predicted) and their commoner mode
    (mode_predicted). A plain model to hold others against; sums are of whole tenths, so they are exact."""
    of = W.partitionBy("source", "target")
    tenths, others = F.round(C("crf") * 10).cast("bigint"), F.count(F.lit(1)).over(of) - 1
    mean = F.when(others > 0, (F.sum(tenths).over(of) - tenths) / (10.0 * others)).otherwise(C("crf"))
    mode = (2 * (F.sum("aq_mode").over(of) - C("aq_mode")) > others).cast("int")
    return select.best_or_closest(views.rated(spark, sf, True)).withColumns({"predicted": mean, "mode_predicted": mode})


def scene_features(spark: SparkSession, sf: str) -> DataFrame:
    """The eight features of each clip from its frames: pictures of 8 x 8, every 13th of which could not be read."""
    f = views.pictures(spark, sf)
    clips = f.groupBy("clip").agg((F.count(F.lit(1)) / 24.0).alias("duration"), F.max(640 * 360 * (1 + C("clip") % 4)).alias("pixels_per_frame"))
    s = feat.scene(f, clips, 8)
    return s.select("clip", "n_frames", *[F.round(c, 6).alias(c) for c in FEATURES])


def picture_features(spark: SparkSession, sf: str) -> DataFrame:
    """The eight features of each clip from frames as bytes: the channels of its pictures, as blue, green and red."""
    f = views.pictures(spark, sf)
    clips = f.groupBy("clip").agg((F.count(F.lit(1)) / 24.0).alias("duration"), F.max(640 * 360 * (1 + C("clip") % 4)).alias("pixels_per_frame"))
    byte = lambda c: F.transform(c, lambda v: F.lpad(F.hex(v), 2, "0"))
    pixels = F.arrays_zip(*[byte(C("channels")[i]).alias(k) for i, k in enumerate("bgr")])
    data = F.unhex(F.array_join(F.transform(pixels, lambda p: F.concat(p["b"], p["g"], p["r"])), ""))
    frames = f.select("clip", "place", F.lit(8).alias("width"), F.lit(8).alias("height"), F.when(C("pixels").isNotNull(), data).alias("data"))
    return pictures.scene(frames, clips).select("clip", "n_frames", *[F.round(c, 5).alias(c) for c in FEATURES])


def frame_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Mean differences of two streams of each clip, one of which lost every seventh frame: paired by number, not by time."""
    f = views.frames(spark, sf).select("clip", "frame", F.element_at("pixels", 1).alias("value"))
    pairs = feat.paired(f, f.where("frame % 7 > 0"), ["clip"])
    return pairs.groupBy("clip").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(C("reference_frame") == C("distorted_frame")).alias("n_same"), F.round(F.avg(F.abs(C("reference") - C("distorted"))), 9).alias("apart"))


def trial_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many trials a store holds per encoder, written and distinct."""
    t = views.trials(spark, sf).withColumn("key", store.key())
    return t.groupBy("encoder").agg(F.count(F.lit(1)).alias("written"), F.countDistinct("key").alias("stored"))


def even_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Four of each segment's crfs, evenly."""
    per = views.trials(spark, sf).groupBy("segment_hash").agg(F.array_sort(F.collect_set("crf")).alias("crfs"))
    return per.select("segment_hash", F.array_join(F.transform(P.even_subsample(C("crfs"), 4), P.short), ",").alias("crfs"))


def trial_store(spark: SparkSession, sf: str) -> DataFrame:
    """A store of every segment's trials, put in three batches, compacted after two, of which a fourth died before its commit: what counts."""
    t = views.trials(spark, sf)
    stored = trialstore.TrialStore(spark, commitlog.scratch(spark, "trials"))
    stored.put(t.where("l_suppkey % 3 = 0"), SEQ)
    stored.put(t.where("l_suppkey % 3 = 1"), SEQ)
    stored.compact()
    stored.put(t.where("l_suppkey % 3 = 2 AND l_partkey % 2 = 0"), SEQ)
    stored._written(t.where("l_suppkey % 3 = 2").withColumn("vmaf", F.lit(0.0)).withColumn("key", store.key()), stored.generation())
    return stored.current().groupBy("segment_hash").agg(F.count(F.lit(1)).alias("n_stored"), F.round(F.sum("vmaf"), 4).alias("vmaf"), F.sum("out_bytes").alias("out_bytes"))


def stored_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals of every segment (the settings of its trials, every third a little off, which rounding takes back for some) against a store of
    half of its trials: what is stored is taken, the rest measured (by the nearest recorded trial) and put; asked again, nothing is measured."""
    t = views.trials(spark, sf)
    measure = searching.nearest_recorded(t)
    stored = trialstore.TrialStore(spark, commitlog.scratch(spark, "trials"), parts(spark))  # as many as the trials need: all goes on by segment
    stored.put(t.where("l_suppkey % 2 = 0"), SEQ)
    asked = t.select("segment_hash", "encoder", (C("crf") + F.when(C("l_orderkey") % 3 == 0, 0.05).otherwise(0.0)).alias("crf"), "aq_mode", "aq_strength")
    asked = kept(dealt(asked).distinct())
    evaluated = lambda: stored.evaluated(asked, views.spaces(spark), measure, "vmaf_v0.6.1neg", 2, True)
    first = evaluated().groupBy("segment_hash").agg(F.count_if("stored").alias("n_stored"), F.count_if(~C("stored")).alias("n_measured"), F.round(F.sum("vmaf"), 4).alias("vmaf"))
    again = evaluated().groupBy("segment_hash").agg(F.count_if(~C("stored")).alias("n_again"), F.round(F.sum("vmaf"), 4).alias("vmaf_again"))
    return first.join(again, "segment_hash")


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment's results of a search by the screen: counts, and the score of the best and of the last of the top candidates."""
    t = views.trials(spark, sf)
    trials = searching.trials_of(t.select("segment_hash", "encoder").distinct(), views.spaces(spark), views.targets(spark), searching.nearest_recorded(t))
    r = searching.results(trials, views.targets(spark))
    return r.select("segment_hash", "target", C("best.feasible").alias("feasible"), "n_trials", "n_encodes", F.size("top").cast("bigint").alias("n_top"), F.round("best.score", 6).alias("score"), F.round(F.try_element_at(F.transform("top", lambda c: c["score"]), F.lit(-1)), 6).alias("last_score"))


def solved(spark: SparkSession, sf: str, method: str) -> DataFrame:
    each = dealt(views.trials(spark, sf)).withColumn("rate", rate()).crossJoin(F.broadcast(views.targets(spark)))  # three rows
    b = select.crf_bracket(each).withColumn("encoder", F.lit("libsvtav1"))
    return design.solve_crf(b, searching.nearest_recorded(views.trials(spark, sf)), method).drop("encoder")


def crf_solve_brent(spark: SparkSession, sf: str) -> DataFrame:
    return solved(spark, sf, "brent")


def brent_guess(spark: SparkSession, sf: str) -> DataFrame:
    """The next crf of every bracket by the last three points that were measured at its setting."""
    b = select.crf_bracket(views.rated(spark, sf, True), n_last=3)
    return select.clamped_guess(b, "brent").select("segment_hash", "aq_mode", "aq_strength", "target", F.round("guess", 6).alias("guess"))


ALL = (dataset_rows, training_rows, infeasible_share, latest_records, design_matrix, training_groups, completeness, train_models, metadata_ranges, package_manifest, run_summary, segment_manifest, complete_manifests, frame_counts, listed_formats, encode_argv, space_guesses, video_plan, fallback_pieces, record_lines, scene_features, picture_features, frame_pairs, trial_counts, even_trials, trial_store, stored_trials, search_results, crf_solve_brent, brent_guess)
