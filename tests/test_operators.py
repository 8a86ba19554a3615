"""Behaviour of single operators on small made cases."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import params, scoring, text
from cadenza.operators import modeling, records, segments, select, store
from cadenza.plans import design, search
from cadenza.sources import media, views
from cadenza.streaming import progress

TRIAL = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, segment_hash string, aq_mode int, aq_strength double, crf double, vmaf double, rate double, target double"


def trials(spark, rows, target=85.0):
    return spark.createDataFrame([(i, 0, 0, 0, 0.0, "seg", m, s, c, v, b / 1e6, target) for i, (m, s, c, v, b) in enumerate(rows)], TRIAL)


def one(df):
    return df.first()[0]


def test_documented_score(spark):
    row = spark.createDataFrame([(88.38, 1 / 3.87, 89.0)], "v double, r double, t double")
    assert one(row.select(scoring.score(F.col("v"), F.col("r"), F.col("t")))) == pytest.approx(0.0282, abs=5e-5)


def test_score_cases_and_weights(spark):
    row = spark.createDataFrame([(99.0, 0.8, 85.0), (79.9, 0.1, 85.0), (100.0, 0.01, 85.0), (90.0, 0.0, 85.0)], "v double, r double, t double")
    assert [r[0] for r in row.select(scoring.score(F.col("v"), F.col("r"), F.col("t"))).collect()][:2] == [0.0, 0.0]
    assert [r[0] for r in row.select(scoring.reason(F.col("v"), F.col("r"), F.col("t"))).collect()][2] == "success (excellent compression)"
    with pytest.raises(ValueError):
        scoring.score(F.col("v"), F.col("r"), F.col("t"), compression_weight=0.5)


@pytest.mark.parametrize(
    ("rows", "best"),
    [([(0, 1.0, 40.0, 86.0, 460000), (0, 1.0, 42.0, 85.2, 350000), (1, 3.0, 39.0, 88.0, 600000), (1, 3.0, 41.0, 84.5, 420000)], (0, 1.0)), ([(0, 2.0, 45.0, 83.0, 300000), (1, 2.0, 45.0, 84.2, 330000)], (1, 2.0))],
)
def test_best_aq_prefers_feasible_compression_else_the_closest(spark, rows, best):
    row = select.best_aq(trials(spark, rows)).first()
    assert (row.aq_mode, row.aq_strength) == best


def test_grid_and_neighbours(spark):
    grid = design.aq_grid(views.spaces(spark), 3)
    svt = [(r.aq_mode, r.aq_strength) for r in grid.where("encoder = 'libsvtav1'").orderBy("seq").collect()]
    assert svt == [(m, float(s)) for m in (0, 1) for s in (1, 2, 3, 4)]
    assert grid.where("encoder = 'libx265'").count() == 15
    near = design.aq_neighbours(grid.where("encoder = 'libsvtav1'")).where("aq_mode = 1 AND aq_strength = 3").orderBy("way")
    assert [(r.next_mode, r.next_strength) for r in near.collect()] == [(0, 3.0), (1, 2.0), (1, 4.0)]


def test_screen_plan_is_eight_settings_by_two_inner_crfs(spark):
    plan = design.screen_plan(views.spaces(spark).where("encoder = 'libsvtav1'")).collect()
    assert len(plan) == 16 and len({(r.aq_mode, r.aq_strength) for r in plan}) == 8
    assert all(20 < r.crf < 55 for r in plan)


@pytest.mark.parametrize("method", ["sobol", "halton", "lhs", "random"])
def test_samples_lie_in_their_space_without_repeats(spark, method):
    points = design.sampled_design(views.spaces(spark), method, 12, seed=3).join(views.spaces(spark), "encoder")
    inside = "crf BETWEEN crf_min AND crf_max AND array_contains(aq_modes, aq_mode) AND aq_strength BETWEEN strength_min AND strength_max"
    assert points.where(f"NOT ({inside})").count() == 0
    assert points.count() == points.select("encoder", "crf", "aq_mode", "aq_strength").distinct().count() > 12
    with pytest.raises(ValueError):
        design.sampled_design(views.spaces(spark), "sobel")


def test_unit_cube_round_trip(spark):
    s = params.space_columns()
    u = params.to_unit(F.lit(40.0), F.lit(1), F.lit(3.0), s)
    back = params.from_unit(u["crf_u"], u["mode_u"], u["strength_u"], s)
    row = views.spaces(spark).where("encoder = 'libsvtav1'").select(*[c.alias(k) for k, c in back.items()]).first()
    assert row.aq_mode == 1 and abs(row.crf - 40) < 0.6 and row.aq_strength == 3.0


def test_guesses(spark):
    row = spark.createDataFrame([(20.0, 90.0, 50.0, 70.0, 85.0, [(20.0, 95.0), (40.0, 80.0), (60.0, 65.0)])], "lo double, vl double, hi double, vh double, t double, h array<struct<crf:double,vmaf:double>>")
    c = F.col
    guess = lambda m: one(row.select(select.crf_guess(m, c("lo"), c("vl"), c("hi"), c("vh"), c("t"), c("h"))))
    assert guess("secant") == pytest.approx(27.5)
    assert 20 < guess("golden") < 50
    assert 20 < guess("brent") < 60


def test_solver_narrows_brackets_to_the_tolerance(spark):
    start = spark.createDataFrame([("a", 85.0, 20.0, 90.0, 50.0, 60.0), ("b", 85.0, 20.0, 90.0, None, None)], "segment_hash string, target double, crf_low double, vmaf_low double, crf_high double, vmaf_high double")
    done = {r.segment_hash: r for r in design.solve_crf(start, rounds=12).collect()}
    assert done["a"].crf_low <= 25.0 <= done["a"].crf_high and done["a"].crf_high - done["a"].crf_low <= 0.5 + 1e-9
    assert done["b"].crf_high is None


def test_boundaries_follow_the_last_kept_cut(spark):
    row = spark.createDataFrame([([3.0, 5.0, 7.0, 9.0, 60.0], 62.0), ([], 20.0)], "cuts array<double>, duration double")
    kept = [r[0] for r in row.select(segments.kept_cuts(F.col("cuts"), F.col("duration"))).collect()]
    assert kept == [[5.0, 9.0], []]
    pieces = [r[0] for r in row.select(segments.split_cuts(F.array(F.lit(5.0), F.lit(9.0)), F.lit(62.0), 24.0)).collect()]
    assert pieces[0] == [5.0, 9.0, round(9 + 53 / 3, 3), round(9 + 106 / 3, 3)]
    assert [r[0] for r in row.select(segments.fallback_cuts(F.col("cuts"), F.col("duration"))).collect()][1] == [6.0, 12.0, 18.0]


def test_text_rules(spark):
    row = spark.createDataFrame([("30000/1001",), ("25",), ("1/0",), ("x",), (None,)], "t string")
    assert [round(r[0], 4) for r in row.select(text.rational(F.col("t"))).collect()] == [29.97, 25.0, 0.0, 0.0, 0.0]
    line = spark.range(1).select(text.concat_line(F.lit("/a'b")), text.preset_number(F.lit(" Slow ")), text.preset_number(F.lit("-2")), text.container(F.lit("av1_nvenc")))
    assert tuple(line.first()) == ("file '/a'\\''b'", 4, -2, "mkv")
    with pytest.raises(Exception, match="preset"):
        spark.range(1).select(text.preset_number(F.lit("99"))).collect()


def test_checkpoint_keeps_the_last_complete_line(spark):
    good = '{"segment_hash":"s","encoder":"e","source":"%s","results":{"85":{"feasible":true},"89.0":{"feasible":true}}}'
    lines = [good % "one", "{broken", "", good % "two", '{"segment_hash":"s","encoder":"e","source":"three","results":{"85":{}}}', (good % "x").replace('"e"', '"other"')]
    got = store.latest_records(store.checkpoint_lines(spark.createDataFrame([("\n".join(lines),)], "value string")), "e", [85.0, 89.0]).collect()
    assert [(r.pos, r.source) for r in got] == [(3, "two")]


def test_dataset_and_checkpoint_round_trip(spark, tmp_path):
    kinds = ", ".join(f"{c} {'string' if c in ('source', 'segment', 'segment_hash', 'encoder') else 'double'}" for c in records.COLUMNS)
    rows = spark.createDataFrame([tuple("x" if "string" in k else 86.0 for k in kinds.split(", "))], kinds)
    records.write_dataset(rows, str(tmp_path / "d"))
    assert records.read_dataset(spark, str(tmp_path / "d")).first().vmaf == "86.0"
    rows.select("source").write.csv(str(tmp_path / "bad"), header=True)
    with pytest.raises(ValueError, match="columns missing"):
        records.read_dataset(spark, str(tmp_path / "bad"))


def test_content_hash_of_small_and_overlapping_files(spark, tmp_path):
    for size in (10, 5000):
        data = bytes(i % 251 for i in range(size))
        (tmp_path / f"{size}.MKV").write_bytes(data)
    (tmp_path / "notes.txt").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.MKV"))
    got = {r.length: r.h for r in files.select("length", media.content_hash(F.col("content"), F.col("length"), 4096).alias("h")).collect()}
    for size, h in got.items():
        data = bytes(i % 251 for i in range(size))
        want = hashlib.sha1(str(size).encode())
        for at in (0, max(0, size // 2 - 2048), max(0, size - 4096)):
            want.update(data[at : at + 4096])
        assert h == want.hexdigest()
    assert [r.path.rsplit("/", 1)[1] for r in media.discover(spark, [str(tmp_path)]).collect()] == ["10.MKV", "5000.MKV"]


def test_split_keeps_sources_together_and_one_on_each_side(spark, sf_dir):
    split = modeling.grouped_split(views.features(spark, sf_dir))
    sides = {r.source: r.n for r in split.groupBy("source").agg(F.countDistinct("validation").alias("n")).collect()}
    assert set(sides.values()) == {1}
    assert 0 < split.where("validation").select("source").distinct().count() < len(sides)


def test_progress_stream_counts_new_files(spark, tmp_path):
    events = spark.createDataFrame([(1.0, "start", None), (4000.0, "done", "{}"), (20000.0, "start", None)], progress.SCHEMA)
    progress.emit(events, str(tmp_path / "events"))
    run = progress.counts(progress.read_stream(spark, str(tmp_path / "events"))).writeStream.outputMode("complete").format("memory").queryName("progress_counts").start()
    run.processAllAvailable()
    progress.emit(events.limit(1), str(tmp_path / "events"))
    run.processAllAvailable()
    run.stop()
    assert {r.event: r.n for r in spark.table("progress_counts").collect()} == {"start": 3, "done": 1}


@pytest.mark.parametrize("strategy", ["screen", "grid", "lhs"])
def test_search_finds_the_greatest_crf_that_meets_the_target(spark, strategy):
    segments = spark.createDataFrame([("a", "libsvtav1"), ("b", "libsvtav1"), ("hopeless", "libsvtav1")], "segment_hash string, encoder string")
    offsets = spark.createDataFrame([("a", 4.0), ("b", 8.0), ("hopeless", -80.0)], "segment_hash string, offset double")
    measure, spaces, targets = search.shifted_surface(offsets), views.spaces(spark), views.targets(spark)
    rows = search.search(segments, spaces, targets, measure, strategy).collect()
    assert len(rows) == 9
    assert all(r.feasible == (r.segment_hash != "hopeless") and (not r.feasible or r.vmaf >= r.target) for r in rows)
    solved = search.solve_targets(search.explore(segments, spaces, measure, strategy), spaces, targets, measure).collect()
    for segment, offset in (("a", 4.0), ("b", 8.0)):
        for target in views.TARGETS:
            short = [110 + offset + 0.2 * r.aq_mode * r.aq_strength - target - r.crf for r in solved if r.segment_hash == segment and r.vmaf >= target]
            assert 0 <= min(short) + 1e-6 and min(short) <= 1.0


def test_recorded_measurements_join_exactly(spark, sf_dir):
    trials = views.trials(spark, sf_dir)
    some = trials.limit(5).select("segment_hash", "encoder", "crf", "aq_mode", "aq_strength").distinct()
    odd = some.withColumn("crf", F.col("crf") + 1000)
    got = search.recorded(trials)(some.unionByName(odd)).collect()
    assert [r.vmaf is None for r in sorted(got, key=lambda r: r.crf)].count(True) == len(got) // 2


@pytest.mark.parametrize("width", [5.0, 37.0, 4096.0])
def test_blocks_of_cuts_give_the_segments_of_the_whole_fold(spark, width):
    rng = np.random.default_rng(int(width))
    made = {}
    for i in range(12):
        gaps = rng.choice([0.04, 0.5, 2.0, 3.999, 4.0, 7.5, 30.0, 90.0], size=rng.integers(0, 120))
        t = np.round(np.cumsum(gaps), 3)
        made[f"s{i}"] = (sorted({float(v) for v in t}), float(np.round((t[-1] if len(t) else 0) + rng.choice([0.02, 3.0, 11.0, 60.0]), 3)))
    whole = spark.createDataFrame([(k, c, d) for k, (c, d) in made.items()], "source string, cuts array<double>, duration double")
    cuts = spark.createDataFrame([(k, v) for k, (c, _) in made.items() for v in c], "source string, t double")
    sources = whole.select("source", "duration")
    plan = segments.boundary_plan(whole)
    want = {(r.source, b) for r in plan.collect() for b in r.boundaries}
    got = segments.boundary_rows(cuts, sources, width=width)
    assert sorted(want) == sorted((r.source, r.boundary) for r in got.collect())
    starts = lambda df: sorted((r.source, r.idx, round(r.start, 3), r.duration) for r in df.collect())
    assert starts(segments.segment_rows(got, sources, width=width)) == starts(segments.segment_starts(segments.pieces(plan)))
