"""Every registered core query gives the rows of its SQL on the smallest data."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = sorted(n for n in entry.all_queries())


def _plain(v):
    """A value that compares between the engines: numbers to six digits, structs and lists as tuples."""
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", CORE)
def test_query_matches_its_sql(spark, name):
    import duckdb

    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = Counter(repr(tuple(_plain(r[i]) for i in order)) for r in cur.fetchall())
    assert Counter(repr(tuple(_plain(r[c]) for c in sorted(names))) for r in rows) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_entry(spark):
    assert entry.entry(spark).columns
