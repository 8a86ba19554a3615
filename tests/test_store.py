from __future__ import annotations

import random

from pyspark.sql import functions as F

from cadenza.operators import store, trialstore
from cadenza.plans import rounds
from cadenza.sources import commitlog, views

SCHEMA = "segment_hash string, encoder string, source string, results map<string,struct<feasible:boolean>>"


def record(segment, source, targets=("85",)):
    return (segment, "e", source, {t: (True,) for t in targets})


def latest(spark, path, targets=(85.0,)):
    return {r.segment_hash: r.source for r in store.latest_records(store.read_checkpoint(spark, path), "e", list(targets)).collect()}


def test_the_last_line_wins_over_twenty_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    rng = random.Random(3)
    want = {}
    for batch in range(20):
        rows = [record(f"s{rng.randrange(6)}", f"{batch}-{i}") for i in range(rng.randrange(0, 5))]
        assert store.append_records(spark.createDataFrame(rows, SCHEMA).repartition(1) if batch % 2 else spark.createDataFrame(rows, SCHEMA).coalesce(1), path) == batch
        if not batch % 2:  # repartition may change the order of a batch's own rows
            want |= {r[0]: r[2] for r in rows}
        else:
            for r in rows:
                want[r[0]] = {x[2] for x in rows if x[0] == r[0]}
    got = latest(spark, path)
    assert set(got) == set(want)
    assert all(got[s] in w if isinstance(w, set) else got[s] == w for s, w in want.items())


def test_a_crashed_append_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "log")
    one = lambda name: spark.createDataFrame([record("s", name)], SCHEMA).selectExpr("to_json(struct(*)) AS value")
    commitlog.append(one("first"), path)
    commitlog.written(one("lost"), path)  # data, but no commit
    (tmp_path / "log" / "commits" / ".torn").write_text('{"batch":1,"place":0,"file":"data/')
    assert latest(spark, path) == {"s": "first"}
    assert commitlog.append(one("second"), path) == 1
    assert latest(spark, path) == {"s": "second"}
    assert commitlog.vacuum(spark, path) == 1 and latest(spark, path) == {"s": "second"}


def test_a_taken_number_is_not_overwritten(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    a, b = spark.createDataFrame([("a",)], "value string"), spark.createDataFrame([("b",)], "value string")
    commitlog.append(a, path)
    monkeypatch.setattr(commitlog.Folder, "names", lambda self, folder, names=commitlog.Folder.names: [] if folder == "commits" else names(self, folder))
    assert commitlog.append(b, path) == 1  # this writer did not see the first one's commit
    assert [r.line for r in commitlog.lines(spark, path).orderBy("pos").collect()] == ["a", "b"]


def test_order_within_a_batch_and_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(0, 4000, 1, 7).selectExpr("string(id) AS value")
    commitlog.append(rows, path)
    assert [int(r.line) for r in commitlog.lines(spark, path).orderBy("pos").collect()] == list(range(4000))
    other = str(tmp_path / "other")
    for source in ("one", "two"):
        store.append_records(spark.createDataFrame([record("s", source), record("t", source, ("85", "89"))], SCHEMA), other)
    assert store.compact_checkpoint(spark, other, "e", [85.0]) == 2
    assert commitlog.lines(spark, other).count() == 2 and latest(spark, other) == {"s": "two", "t": "two"}
    assert latest(spark, other, (85.0, 89.0)) == {"t": "two"}
    assert commitlog.vacuum(spark, other) == 2 and latest(spark, other) == {"s": "two", "t": "two"}
    store.append_records(spark.createDataFrame([record("s", "three")], SCHEMA), other)
    assert latest(spark, other) == {"s": "three", "t": "two"}


def test_empty_logs_and_batches(spark, tmp_path):
    assert commitlog.lines(spark, str(tmp_path / "none")).count() == 0
    path = str(tmp_path / "log")
    store.append_records(spark.createDataFrame([], SCHEMA), path)
    assert latest(spark, path) == {}



TRIAL = "segment_hash string, encoder string, crf double, aq_mode int, aq_strength double, vmaf_model string, n_subsample int, ref_bytes bigint, out_bytes bigint, vmaf double"


def trial(segment="s", crf=30.0, mode=1, strength=2.0, vmaf=90.0, model="m", subsample=2):
    return (segment, "libsvtav1", crf, mode, strength, model, subsample, 1000, 500, vmaf)


def test_the_last_put_counts_and_others_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trialstore, "COMPACT_AFTER", 3)
    stored = trialstore.TrialStore(spark, str(tmp_path / "store"), 4)
    put = lambda *rows: stored.put(spark.createDataFrame(list(rows), TRIAL))
    assert stored.current().count() == 0
    put(trial(vmaf=80.0), trial("t", vmaf=70.0), trial(model="other", vmaf=1.0), trial(subsample=1, vmaf=2.0))
    put(trial(crf=30.04, vmaf=81.0))  # rounds to the same key
    held = lambda: sorted((r.segment_hash, r.vmaf) for r in stored.current().collect())
    assert held() == [("s", 1.0), ("s", 2.0), ("s", 81.0), ("t", 70.0)]
    for i in range(6):
        put(trial(f"u{i}", vmaf=float(i)), trial(vmaf=82.0 + i))
    assert stored.generation() > 0 and len(held()) == 10 and ("s", 87.0) in held()
    # another session's view of the same folder, and one put that died before its commit
    again = trialstore.TrialStore(spark, str(tmp_path / "store"), 4)
    again._written(spark.createDataFrame([trial(vmaf=0.0)], TRIAL).withColumn("key", store.key()), again.generation())
    assert sorted((r.segment_hash, r.vmaf) for r in again.current().collect()) == held()


def test_lookups_do_not_move_what_is_stored(spark, tmp_path):
    stored = trialstore.TrialStore(spark, str(tmp_path / "store"), 4)
    stored.put(spark.createDataFrame([trial(f"s{i}", vmaf=float(i)) for i in range(50)], TRIAL))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([trial(f"s{i}") for i in range(0, 100, 10)], TRIAL).drop("vmaf", "out_bytes", "ref_bytes").withColumn("key", store.key())
        found = stored.lookup(asked)
        assert {r.segment_hash: r.vmaf for r in found.collect() if r.hit} == {f"s{i}": float(i) for i in range(0, 50, 10)}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("== Initial Plan ==")[0]
    above = final.split("FileScan parquet")[0].split("SortMergeJoin")[1]  # what happens to the stored side, and the proposals'
    assert above.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in above and "SelectedBucketsCount: 4" in final


def test_evaluated_measures_each_key_once(spark, tmp_path):
    stored = trialstore.TrialStore(spark, str(tmp_path / "store"), 4)
    stored.put(spark.createDataFrame([trial(crf=30.2, vmaf=91.0), trial(crf=55.0, vmaf=50.0)], TRIAL))
    seen = []

    def measure(asked):
        seen.append(sorted((r.crf, r.aq_mode, r.aq_strength) for r in asked.collect()))
        return asked.withColumns({"vmaf": F.when(F.col("crf") < 50, 100 - F.col("crf")), "out_bytes": F.lit(1).cast("long"), "ref_bytes": F.lit(2).cast("long")})

    proposals = [(30.25, 1, 2.0), (90.0, 1, 2.0), (33.0, 7, 2.4), (33.04, 1, 2.0), (52.0, 0, 1.0)]
    asked = spark.createDataFrame([("s", "libsvtav1", *p, i) for i, p in enumerate(proposals)], "segment_hash string, encoder string, crf double, aq_mode int, aq_strength double, seq int")
    run = lambda: {r.seq: (r.crf, r.aq_mode, r.aq_strength, r.vmaf, r.stored) for r in stored.evaluated(asked, views.spaces(spark), measure, "m", 2).collect()}
    assert run() == {0: (30.2, 1, 2.0, 91.0, True), 1: (55.0, 1, 2.0, 50.0, True), 2: (33.0, 1, 2.0, 67.0, False), 3: (33.0, 1, 2.0, 67.0, False), 4: (52.0, 0, 1.0, None, False)}
    assert run()[3] == (33.0, 1, 2.0, 67.0, True) and run()[4][3] is None  # what can't be measured is asked for again
    assert seen == [[(33.0, 1, 2.0), (52.0, 0, 1.0)], *2 * [[(52.0, 0, 1.0)]]]


def test_what_lies_by_segment_is_not_dealt_out_again(spark, tmp_path):
    stored = trialstore.TrialStore(spark, str(tmp_path / "store"), rounds.parts(spark))
    stored.put(spark.createDataFrame([trial(f"s{i}", vmaf=float(i)) for i in range(20)], TRIAL))
    asked = rounds.kept(rounds.dealt(spark.createDataFrame([trial(f"s{i}", crf=30.0 + i % 2) for i in range(40)], TRIAL).select("segment_hash", "encoder", "crf", "aq_mode", "aq_strength")))
    measure = lambda p: p.withColumns({"vmaf": F.lit(50.0), "out_bytes": F.lit(1).cast("long"), "ref_bytes": F.lit(2).cast("long")})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per = stored.evaluated(asked, views.spaces(spark), measure, "m", 2, True).groupBy("segment_hash").agg(F.max("stored").alias("stored"), F.max("vmaf").alias("vmaf"))
        assert {r.segment_hash: (r.stored, r.vmaf) for r in per.collect()} == {f"s{i}": (i < 20 and i % 2 == 0, float(i) if i < 20 and i % 2 == 0 else 50.0) for i in range(40)}
        assert "Exchange hashpartitioning" not in per._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
