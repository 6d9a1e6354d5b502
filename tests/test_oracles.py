"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from chronoloom.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda x: round(x, 9) if isinstance(x, float) and not math.isnan(x) else x
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLE_SQL[name])
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
