"""The operators' SQL gives the rows of the operators."""

from __future__ import annotations

import duckdb
import pytest

from cadenza.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = con.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    order = lambda row: [(v is not None, v) for v in row]
    rows = sorted((tuple(dict(zip(expected.columns, r, strict=True))[c] for c in columns) for r in expected.fetchall()), key=order)
    for a, b in zip(sorted((tuple(r[c] for c in columns) for r in found.collect()), key=order), rows, strict=True):
        assert a == pytest.approx(b) if all(isinstance(x, int | float) for x in a) else a == b
