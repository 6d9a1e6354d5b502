"""Queries that cover whole tables, against loops over all rows and against their SQL."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest

from chronoloom import clock
from chronoloom.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def result(spark, name, *columns):
    return [tuple(r[c] for c in columns) for r in QUERIES[name](spark, FOLDER).collect()]


def by_sql(duck, name, *columns):
    """Rows of the registered SQL."""
    rows = duck.sql(ORACLE_SQL[name])
    return [tuple(r[rows.columns.index(c)] for c in columns) for r in rows.fetchall()]


def test_every_order_is_interpolated(spark, duck):
    want = defaultdict(lambda: [0, 0.0, 0])
    for a, b, x, y, k, u, v in duck.sql("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_partkey, l_suppkey FROM lineitem").fetchall():
        w = want[a, b]
        w[0], w[1], w[2] = w[0] + 1, w[1] + x + (y - x) * k, w[2] + int(u + (v - u) * k)
    columns = ("a", "b", "n", "mid", "whole")
    got = {r[:2]: r[2:] for r in result(spark, "interpolate", *columns)}
    assert got.keys() == want.keys()
    for key, (n, mid, whole) in got.items():
        assert (n, whole) == (want[key][0], want[key][2]) and mid == pytest.approx(want[key][1], abs=1e-6)
    assert any(a % 10 for a, _ in got)
    rows = by_sql(duck, "interpolate", *columns)
    assert len(rows) == len(got)
    for a, b, n, mid, whole in rows:
        assert got[a, b] == (n, pytest.approx(mid, abs=1e-9), whole)


def test_all_streams_are_merged(spark, duck):
    rows = duck.sql("SELECT event_type, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 FROM events").fetchall()
    stream = {name: n for n, name in enumerate(sorted({r[0] for r in rows}))}
    assert len(stream) > 2
    got = result(spark, "k_way_merge", "pts", "stream", "frame_id")
    assert got == sorted((pts, stream[name], i) for name, i, pts in rows)
    assert got == sorted(by_sql(duck, "k_way_merge", "pts", "stream", "frame_id"))


def test_timeline_visits_all_shows(spark, duck):
    starts = [r[0] for r in duck.sql("SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 FROM events").fetchall()]
    got = result(spark, "offline_timeline", "pts")
    assert got == sorted({(t,) for s in starts for t in (s, s + clock.HOUR)})
    assert sorted(by_sql(duck, "offline_timeline", "pts")) == got
