"""Every query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from paperlode.plans import catalog

SLOW = {"statement_facts", "quick_bank_answers", "quick_return_answers", "return_facts", "fact_summaries", "facts_rendered"}


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        names = [c[0] for c in cur.description]
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
        assert sorted(names) == columns and rows == want


def test_entry_without_the_subpackage_is_whole():
    assert catalog.FLAGSHIP in catalog.QUERIES and set(catalog.ORACLES) <= set(catalog.QUERIES)
