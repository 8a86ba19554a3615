"""What goes on by segment is dealt out by segment once, before it is multiplied by the targets and before anything is sorted."""

from __future__ import annotations

import pytest

from cadenza.plans import queries
from cadenza.sources import commitlog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["best_or_closest", "result_summary", "mode_accuracy", "brent_guess", "crf_bracket"])
def test_trials_are_dealt_out_before_targets_and_sorts(spark, sf_dir, name):
    text = plan(queries.QUERIES[name](spark, sf_dir))
    dealt = text.index("Exchange hashpartitioning(segment_hash")  # children come after their parents
    assert text.count("Exchange hashpartitioning(segment_hash") == 1
    assert text.index("BroadcastNestedLoopJoin") < dealt
    assert "Sort [" not in text[dealt:]


def test_records_are_written_compressed_and_read_back(spark, tmp_path):
    path = str(tmp_path / "log")
    commitlog.append(spark.createDataFrame([(f"line {i} " * 50,) for i in range(100)], "value string").coalesce(1), path)
    files = [f for f in (tmp_path / "log" / "data").rglob("part-*")]
    assert files and all(f.suffix == ".gz" for f in files) and sum(f.stat().st_size for f in files) < 5000
    assert [r.line for r in commitlog.lines(spark, path).orderBy("pos").collect()] == [f"line {i} " * 50 for i in range(100)]


def test_what_is_dealt_out_stays_where_it_lies(spark):
    from cadenza.plans.rounds import dealt

    rows = spark.createDataFrame([(f"s{i % 7}", i % 3, float(i)) for i in range(60)], "segment_hash string, aq_mode int, crf double")
    known = dealt(rows).groupBy("segment_hash", "aq_mode").agg({"crf": "max"})
    asked = dealt(rows)
    text = plan(asked.hint("merge").join(known, ["segment_hash", "aq_mode"], "left"))
    assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") > 0


def test_later_rounds_of_a_search_shuffle_nothing(spark, sf_dir):
    from cadenza.operators import select
    from cadenza.plans import search
    from cadenza.plans.rounds import SEQ, grown, rated
    from cadenza.sources import views

    t, before = views.trials(spark, sf_dir), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    measure = search.nearest_recorded(t)
    explored = search.explore(t.select("segment_hash", "encoder").distinct(), views.spaces(spark), measure, "screen", 8)
    again = search.explore(t.select("segment_hash", "encoder").distinct(), views.spaces(spark), measure, "halton", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = explored.select("segment_hash", "encoder", "crf", "aq_mode", "aq_strength")
        ranked = select.rank_aq(rated(grown(explored, again), views.targets(spark)), 2, SEQ)
        for df in (measure(asked), ranked):
            assert "Exchange hashpartitioning" not in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parts_grow_with_the_recorded_trials(spark):
    from cadenza.plans import rounds

    rounds.spread(spark.range(10 * rounds.PART_TRIALS + 1))
    assert rounds.dealt(spark.createDataFrame([("a",)], "segment_hash string")).rdd.getNumPartitions() == 11
    rounds.spread(spark.range(1))
    assert rounds.parts(spark) == 4
