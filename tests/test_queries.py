"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sievelog import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order], *[tuple(r[i] for i in order) for r in found]), key=repr)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "events", "documents", "pages"):
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    frame = q.queries()[name](spark, DATA)
    if name not in q.oracle_sql():
        assert frame.count()
        return
    got = con.sql(q.oracle_sql()[name])
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(got.columns, got.fetchall())
