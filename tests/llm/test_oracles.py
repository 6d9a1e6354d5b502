"""Queries with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from chronoloom.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = QUERIES[name](spark, FOLDER), duck.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = lambda columns, rows: sorted((tuple(r[columns.index(n)] for n in names) for r in rows), key=repr)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
