"""Manifests, datasets, training, argument lists, scene features: small made cases."""

from __future__ import annotations

import hashlib
import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import params, text
from cadenza.operators import features, modeling, records, segments, select, store, training
from cadenza.plans import design
from cadenza.sources import manifests, media, views


def one(df):
    return df.first()[0]


def test_discovery_keeps_named_files_and_skips_what_is_not_there(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.MP4", "sub/b.mkv", "sub/c.txt", "odd.bin"):
        (tmp_path / name).write_bytes(b"x" * 10)
    found = media.discover(spark, [str(tmp_path), str(tmp_path / "odd.bin"), str(tmp_path / "a.MP4"), str(tmp_path / "gone")])
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.MP4", "odd.bin", "b.mkv"]
    assert media.discover(spark, [str(tmp_path / "gone")]).count() == 0
    assert media.discover(spark, [str(tmp_path)], limit=1).count() == 1


def test_large_files_are_hashed_by_three_chunks(spark, tmp_path):
    data = bytes(i % 251 for i in range(50_000))
    (tmp_path / "a b.mkv").write_bytes(data)
    row = media.file_hashes(media.discover(spark, [str(tmp_path)]), 4096).first()
    want = hashlib.sha1(b"50000")
    for at in (0, 25_000 - 2048, 50_000 - 4096):
        want.update(data[at : at + 4096])
    assert (row.length, row.hash) == (50_000, want.hexdigest())


def test_counts_are_whole_lines(spark):
    lines = spark.createDataFrame([("a", 0, "n 12"), ("a", 1, " 66,"), ("a", 2, "7"), ("b", 0, "none")], "doc string, pos int, line string")
    assert {r.doc: r.n_frames for r in media.frame_count(lines).collect()} == {"a": 66, "b": None}


def test_bundles_are_found_or_an_error(spark):
    kinds = "path string, encoder string, target double, low double, high double, heads array<string>"
    heads = ["crf", "aq_mode", "aq_strength"]
    known = media.bundles(spark.createDataFrame([("e/target_85", "e", 85.0, None, None, ["crf"]), ("e", "e", None, 84.0, 90.0, heads), ("f", "f", None, None, None, heads), ("g", "g", None, 84.0, 90.0, ["crf"])], kinds))
    asked = spark.createDataFrame([("e", 85.0), ("e", 90.4), ("e", 93.0), ("f", 10.0), ("g", 85.0)], "encoder string, target double")
    got = {(r.encoder, r.target): (r.path, r.fits) for r in media.find_bundle(asked, known).collect()}
    assert got == {("e", 85.0): ("e/target_85", True), ("e", 90.4): ("e", True), ("e", 93.0): ("e", False), ("f", 10.0): ("f", True), ("g", 85.0): (None, False)}
    assert media.must_find(media.find_bundle(asked.where("encoder = 'f'"), known)).first().path == "f"
    for bad in ("encoder = 'g'", "target = 93"):
        with pytest.raises(Exception, match="no model|outside"):
            media.must_find(media.find_bundle(asked.where(bad), known)).collect()


def test_manifests_skip_bad_items_and_gate_on_files(spark):
    good = {"index": 0, "path": "p0", "source": "s", "start": 0.0, "duration": 4.5}
    items = [good, good | {"index": "1", "path": "p1", "start": "4.5"}, {"index": 2}, good | {"start": "soon"}, 7, good | {"path": "q", "source": "t"}]
    docs = spark.createDataFrame([("d", json.dumps(items)), ("x", "{}"), ("y", None)], "doc string, manifest string")
    rows = manifests.segment_rows(docs)
    assert sorted((r["index"], r.path, r.start) for r in rows.collect()) == [(0, "p0", 0.0), (0, "q", 0.0), (1, "p1", 4.5)]
    files = spark.createDataFrame([("p0",), ("q",)], "path string")
    sources = spark.createDataFrame([("s",), ("u",)], "source string")
    reused = manifests.resumed(sources, rows, files)
    assert [r.path for r in reused.collect()] == ["p0"] and [r.source for r in manifests.to_cut(sources, reused).collect()] == ["u"]
    assert [r.path for r in manifests.complete(rows, files).collect()] == ["q"]


def _dataset(spark, n, mode):
    rows = spark.range(n).withColumn("target", F.explode(F.array(F.lit(85.0), F.lit(89.0))))
    said = {"source": "concat('src_', id % 8)", "segment": "concat('seg/', id)", "segment_hash": "concat('h', id)", "target": "target", "feasible": "id % 10 > 0", "vmaf": "90.0D", "rate": "0.5D", "ratio": "2.0D", "score": "0.3D", "encoder": "'libsvtav1'", "n_trials": "9"}
    said |= {c: f"cast(id * {i + 3} % 40 as double)" for i, c in enumerate(views.FEATURES)} | {"crf": "cast(25 + id * 3 % 40 / 2.0 - (target - 85) as double)", "aq_mode": f"cast({mode} as int)", "aq_strength": "2.0D"}
    return rows.selectExpr(*[f"{v} AS {k}" for k, v in said.items()])


def test_dataset_round_trip_and_design_matrix(spark, tmp_path):
    rows = _dataset(spark, 40, "id % 2")
    records.write_dataset(rows, str(tmp_path / "d"))
    back = records.read_dataset(spark, str(tmp_path / "d"))
    assert len(records.COLUMNS) == 22 and set(back.columns) == set(records.COLUMNS) and dict(back.dtypes)["crf"] == "string"
    m = training.design_matrix(back, 85.0)
    assert m.count() == 36 and training.TARGET_FEATURE not in m.columns
    assert training.design_matrix(back, 85.0000001, feasible_only=False).count() == 40
    assert training.design_matrix(back, with_target=True).select(training.TARGET_FEATURE).distinct().count() == 2
    with pytest.raises(ValueError, match="columns missing"):
        rows.drop("segment").write.csv(str(tmp_path / "bad"), header=True)
        records.read_dataset(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        rows.limit(0).coalesce(1).write.csv(str(tmp_path / "none"), header=True)
        records.read_dataset(spark, str(tmp_path / "none"))


def test_training_saving_loading_and_prediction(spark, tmp_path):
    rows = _dataset(spark, 120, "id % 2").cache()
    quick = training.Settings(trees=4, depth=4, step=0.5, least_rows=20, quantile=0.2)  # the first tree weighs no more than others
    bundle = training.train(rows, "libsvtav1", 85.0, quick)
    assert bundle.heads["aq_strength"] == ("constant", 2.0) and bundle.heads["aq_mode"][0] == "classes" and bundle.heads["crf"][0] == "gbt"
    assert bundle.metadata["n_train"] == 108 and bundle.metadata["training_targets"] == [85.0] and bundle.metadata["metrics"]["crf_mae"] < 4
    with pytest.raises(ValueError, match="at least"):
        training.train(rows.limit(10), "libsvtav1", 85.0, quick)
    path = training.bundle_path(str(tmp_path), "libsvtav1", 85.0)
    assert path.endswith("libsvtav1/target_85")
    training.save(spark, bundle, path)
    again = training.load(spark, path)
    asked = rows.where("target = 85").drop("crf", "aq_mode", "aq_strength").crossJoin(views.spaces(spark).where("encoder = 'libsvtav1'").drop("encoder"))
    said = lambda b, t=None: [tuple(r) for r in training.predict(asked, b, params.space_columns(), t).select("segment_hash", "crf", "aq_mode", "aq_strength").orderBy("segment_hash").collect()]
    assert said(bundle) == said(again)
    assert all(20 <= r[1] <= 55 and r[2] in (0, 1) and r[3] == 2.0 for r in said(again))
    whole = training.train(rows, "libsvtav1", None, quick)
    with pytest.raises(ValueError, match="needs a target"):
        training.predict(asked, whole, params.space_columns())
    low, high = (np.mean([r[1] for r in said(whole, t)]) for t in (89.0, 85.0))
    assert low < high
    assert training.outside(rows.withColumn("luma_mean", F.lit(1e6)).limit(3), bundle).select("feature").distinct().collect()[0][0] == "luma_mean"
    spark.createDataFrame([('{"schema_version": 9}',)], "value string").write.text(f"{tmp_path}/odd/metadata")
    with pytest.raises(ValueError, match="metadata"):
        training.load(spark, f"{tmp_path}/odd")


def test_forests(spark):
    bundle = training.train(_dataset(spark, 60, "1"), "libsvtav1", 85.0, training.Settings(estimator="forest", trees=4, depth=2, least_rows=5))
    assert bundle.heads["crf"][0] == "forest" and bundle.heads["aq_mode"] == ("constant", 1.0)


def test_percentiles_by_counts(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], [90, 10]), "c": np.array([3.5]), "d": np.zeros(40), "e": rng.exponential(size=77)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x], "g string, v double")
    for share in (0.0, 0.5, 0.9, 0.95, 1.0):
        got = {r.g: r.value for r in modeling.percentile_by_counts(rows, "g", "v", share).collect()}
        assert got == pytest.approx({k: float(np.percentile(x, share * 100)) for k, x in values.items()}, abs=1e-8)


def test_scene_features_are_those_of_plain_arrays(spark):
    rng = np.random.default_rng(7)
    frames = rng.integers(0, 256, (5, 6, 9)).astype(float)
    rows = [("c", i, None if i == 2 else f.ravel().tolist(), [[int(v) for v in f.ravel()], [int(v) // 8 for v in f.ravel()]]) for i, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "clip string, place int, pixels array<double>, channels array<array<int>>")
    clips = spark.createDataFrame([("c", 2.5, 1000), ("short", 1.0, 1)], "clip string, duration double, pixels_per_frame int")
    got = features.scene(df, clips, 9).first()
    kept = [frames[i] for i in (0, 1, 3, 4)]

    def edges(f):
        p = np.pad(f, 1, mode="reflect")
        gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
        gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
        return np.hypot(gx, gy).std()

    def entropy(v):
        n = np.bincount(v.astype(int).ravel())
        q = n[n > 0] / n.sum()
        return -(q * np.log2(q)).sum()

    apart = [np.abs(a - b) for a, b in zip(kept[1:], kept[:-1], strict=True)]
    want = {"spatial_information": np.mean([edges(f) for f in kept]), "temporal_information": np.mean([a.std() for a in apart]), "motion_p95": np.percentile([a.mean() / 255 for a in apart], 95), "duration": 2.5, "luma_mean": np.mean([f.mean() for f in kept]), "luma_std": np.mean([f.std() for f in kept]), "color_complexity": np.mean([(entropy(f) + entropy(f // 8)) / 2 for f in kept]), "log_pixels": 3.0}
    assert got.n_frames == 4 and {k: got[k] for k in want} == pytest.approx({k: float(v) for k, v in want.items()}, rel=1e-9)
    lone = spark.createDataFrame([("short", 0, [1.0] * 9, [[1]]), ("short", 1, None, None)], df.schema)
    with pytest.raises(Exception, match="fewer than two"):
        features.scene(lone, clips, 3).collect()


def test_lists_of_unequal_length_are_an_error(spark):
    cut = spark.createDataFrame([("s", 0), ("s", 1)], "source string, idx int")
    infos = cut.withColumn("fps", F.lit(24.0))
    assert segments.side_by_side(cut, {"infos": infos}).count() == 2
    for bad in (infos.where("idx = 0"), infos.union(spark.createDataFrame([("s", 2, 1.0)], infos.schema))):
        with pytest.raises(Exception, match="unequal"):
            segments.side_by_side(cut, {"infos": bad}).collect()


def test_brent_converges_with_its_history_and_settles_within_the_tolerance(spark):
    start = spark.createDataFrame([("a", 85.0, 20.0, 90.0, 50.0, 60.0)], "segment_hash string, target double, crf_low double, vmaf_low double, crf_high double, vmaf_high double")
    for method in ("secant", "brent", "golden"):
        r = design.solve_crf(start, rounds=12, method=method).first()
        assert r.crf_low <= 25.0 <= r.crf_high and r.crf_high - r.crf_low <= 0.5 + 1e-9, method
    assert "history" not in design.solve_crf(start, method="brent").columns
    with pytest.raises(ValueError, match="history"):
        select.with_guess(start, "brent")


def test_sobol_points_fill_every_dyadic_box(spark):
    at = spark.range(64)
    for seed in (0, 5):
        rows = at.select(*[design.sobol(F.col("id"), a, seed).alias(f"u{a}") for a in range(3)]).collect()
        for a in range(3):
            assert sorted(int(r[a] * 64) for r in rows) == list(range(64))
        for a, b in ((0, 1), (1, 2), (0, 2)):
            assert len({(int(r[a] * 4), int(r[b] * 4)) for r in rows}) == 16


def _unscrambled(i: int, axis: int) -> int:
    x = 0
    for j, v in enumerate(design.sobol_directions()[axis]):
        x ^= (i >> j & 1) * v
    return x


def _scrambled(i: int, axis: int, seed: int) -> float:
    x, out = _unscrambled(i, axis), 0
    for k in range(30):
        odd = int(hashlib.md5(f"{seed}:sobol{axis}:{k}:{x >> (30 - k)}".encode()).hexdigest()[0], 16) & 1
        out = 2 * out + ((x >> (29 - k) & 1) ^ odd)
    return (out + 0.5) / 2**30


def test_sobol_points_are_scrambled_digit_by_digit(spark):
    for axis in range(3):
        got = [r[0] for r in spark.range(40).orderBy("id").select(design.sobol(F.col("id"), axis, 4)).collect()]
        assert got == [_scrambled(i, axis, 4) for i in range(40)]
    # means of a smooth function: the scramble's error over seeds is well below that of a shift of all digits
    error = lambda points: statistics.fmean(u * u for u in points) - 1 / 3
    turned = [error([_scrambled(i, 1, seed) for i in range(64)]) for seed in range(20)]
    plain = [_unscrambled(i, 1) for i in range(64)]
    shifted = [error([((p ^ (hash_ % 2**30)) + 0.5) / 2**30 for p in plain]) for hash_ in (int(hashlib.md5(str(s).encode()).hexdigest(), 16) for s in range(20))]
    root = lambda errors: math.sqrt(statistics.fmean(e * e for e in errors))
    assert root(turned) < 0.5 * root(shifted)


def test_halton_digits_are_permuted_and_fill_every_box(spark):
    for base in (2, 3, 5):
        orders = design.digit_orders(base, 9)
        assert all(sorted(o) == list(range(base)) for o in orders) and len({tuple(o) for o in orders}) > 1
        got = [r[0] for r in spark.range(1, base**3 + 1).orderBy("id").select(design.halton(F.col("id"), base, 9)).collect()]
        assert sorted(int(u * base**3) for u in got) == list(range(base**3))
        plain = lambda i: (sum(o[i // base**k % base] * base ** (len(orders) - 1 - k) for k, o in enumerate(orders)) + 0.5) / base ** len(orders)  # noqa: B023, E731
        assert got == [plain(i) for i in range(1, base**3 + 1)]


def test_checkpoint_files_are_read_by_lines_in_order(spark, tmp_path):
    good = '{"segment_hash":"s","encoder":"e","source":"%s","results":{"85":{"feasible":true}}}'
    (tmp_path / "part-1.json").write_text("\n".join([good % "one", "{broken", "", good % "two"]) + "\n")
    (tmp_path / "part-0.json").write_text(good % "zero" + "\n")
    got = store.latest_records(store.read_checkpoint(spark, str(tmp_path)), "e", [85.0]).collect()
    assert [r.source for r in got] == ["two"]
    rows = spark.createDataFrame([("x", "e")], "segment_hash string, encoder string")
    store.append_records(rows, str(tmp_path / "more"))
    store.append_records(rows, str(tmp_path / "more"))
    assert store.read_checkpoint(spark, str(tmp_path / "more")).count() == 2


def test_a_store_that_is_off_hits_nothing(spark, sf_dir):
    asked = views.trials(spark, sf_dir).limit(5)
    assert store.lookup(asked, records.no_trials(spark)).where("hit").count() == 0


def test_escapes_and_formats(spark):
    lines = spark.createDataFrame([("a", 1, "  Supported pixel formats: x  y x"), ("a", 2, "Supported pixel formats: z"), ("b", 0, "none")], "doc string, pos int, line string")
    assert {r.doc: r.formats for r in media.supported_formats(lines).collect()} == {"a": ["x", "y"], "b": []}
    assert one(spark.range(1).select(text.escape_filter_path(F.lit("C:/a'b[1]")))) == "C\\\\:/a\\'b\\[1\\]"


def test_implausible_scores_and_missing_inputs_are_errors(spark):
    logs = spark.createDataFrame([("a", '{"frames":[{"frameNum":0,"metrics":{"vmaf":90}}],"pooled_metrics":{"vmaf":{"mean":90}}}'), ("b", '{"frames":[{"frameNum":0,"metrics":{"vmaf":190}}],"pooled_metrics":{"vmaf":{"mean":190}}}')], "segment_hash string, log string")
    rows = media.quality_rows(logs)
    assert media.must_be_plausible(rows.where("segment_hash = 'a'")).first()["mean"] == 90.0
    with pytest.raises(Exception, match="implausible"):
        media.must_be_plausible(rows).collect()
    cut, files = spark.createDataFrame([("p", 0), ("q", 1)], "path string, idx int"), spark.createDataFrame([("p", 5), ("q", 0)], "path string, length bigint")
    assert segments.all_there(cut.where("idx = 0"), files).first().path == "p"
    with pytest.raises(Exception, match="missing or empty: q"):
        segments.all_there(cut, files).collect()


def test_even_subsample(spark):
    row = spark.createDataFrame([(list(range(10)), [1, 2])], "a array<int>, b array<int>")
    got = row.select(params.even_subsample(F.col("a"), 4), params.even_subsample(F.col("b"), 4), params.even_subsample(F.col("a"), 1)).first()
    assert [list(x) for x in got] == [[0, 3, 6, 9], [1, 2], [0]]


def test_saved_bundles_are_found_by_a_scan(spark, tmp_path):
    rows = _dataset(spark, 60, "id % 2").cache()
    quick = training.Settings(trees=2, depth=2, step=0.5, least_rows=5)
    root = str(tmp_path / "models")
    for t, b in (training.train_all(rows, "libsvtav1", quick) | {None: training.train(rows, "libsvtav1", None, quick)}).items():
        training.save(spark, b, training.bundle_path(root, "libsvtav1", t))
    spark.createDataFrame([('{"schema_version": 9, "encoder": "x"}',)], "value string").write.text(f"{root}/x/metadata")
    spark.createDataFrame([("no json",)], "value string").write.text(f"{root}/y/target_3/metadata")
    known = media.scan_bundles(spark, root)
    assert [(r.path.rsplit("/models/")[1], r.encoder, r.target, r.low, r.high) for r in known.orderBy("path").collect()] == [("libsvtav1", "libsvtav1", None, 85.0, 89.0), ("libsvtav1/target_85", "libsvtav1", 85.0, 85.0, 85.0), ("libsvtav1/target_89", "libsvtav1", 89.0, 89.0, 89.0)]
    asked = spark.createDataFrame([("libsvtav1", 85.0), ("libsvtav1", 87.0), ("libsvtav1", 99.0), ("other", 85.0)], "encoder string, target double")
    found = {(r.encoder, r.target): (r.path and r.path.rsplit("/models/")[1], r.fits) for r in media.find_bundle(asked, known).collect()}
    assert found == {("libsvtav1", 85.0): ("libsvtav1/target_85", True), ("libsvtav1", 87.0): ("libsvtav1", True), ("libsvtav1", 99.0): ("libsvtav1", False), ("other", 85.0): (None, False)}
    path = known.where("target = 85").first().path
    assert training.load(spark, path).metadata["target"] == 85.0
