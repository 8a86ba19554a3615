"""Every engine query with SQL is held against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from cadenza.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def table(rows, columns):
    def cell(v):
        return round(v, 5) + 0.0 if isinstance(v, float) else tuple(map(cell, v)) if isinstance(v, list) else v

    return sorted((tuple(cell(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    found = queries.QUERIES[name](spark, sf_dir)
    expected = duck.sql(oracles.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    rows = [dict(zip(expected.columns, r, strict=True)) for r in expected.fetchall()]
    assert table([r.asDict() for r in found.collect()], columns) == table(rows, columns)


def test_every_query_is_registered_once():
    assert len(queries.QUERIES) == len(queries.ALL)
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


def test_top_k_is_limited_before_the_shuffle_and_targets_are_broadcast(spark, sf_dir):
    plan = queries.top_trials(spark, sf_dir)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastExchange" in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = queries.progress_counts(spark, sf_dir)._jdf.queryExecution().toString()
    schema = plan.split("ReadSchema: ")[-1].split("\n")[0]
    assert "event_type" in schema and "user_id" not in schema
