"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from helpers import plain, rows_of
from rowtide import plans

ROOT = "/root/testdata/sf0.001"
QUERIES, ORACLE = plans.queries(), plans.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(ROOT)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{f}'")
    return c


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, con, name):
    got = QUERIES[name](spark, ROOT)
    want = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    place = [want.columns.index(c) for c in cols]
    expected = [tuple(plain(r[i]) for i in place) for r in want.fetchall()]
    expected.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows_of(got, cols) == expected
