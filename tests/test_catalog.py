"""Every query with SQL gives the rows that DuckDB gives for that SQL; the others give rows."""

from __future__ import annotations

import datetime
import os
from pathlib import Path

import duckdb
import pytest

from ledgerlark import catalog

D = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _plain(x):
    if x is None:
        return ""
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat().removesuffix("T00:00:00")
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_plain, x)) + "]"
    return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows or catalog.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).collect()  # the least table has few days in common
        return
    cur = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert rows or catalog.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).collect()  # no query passes on no rows
    order = [df.columns.index(c) for c in names]
    assert sorted(tuple(_plain(r[i]) for i in order) for r in rows) == sorted(tuple(map(_plain, r)) for r in want)
