"""Chains of dates do not depend on how rows are partitioned or batched."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from paperlode.operators import dates, rejects, statement_rows
from paperlode.operators.dates import read_dates
from paperlode.operators.rejects import load_raw_rows, load_statement_rows

T = datetime(2024, 1, 1)
LINES = "doc_id string, line_no int, cells array<string>, source string, doc_type string, loaded_at timestamp"
HEAD = ["Date", "Details", "Debit", "Credit", "Balance"]


def days(n, form):
    return [(datetime(2022, 1, 1) + timedelta(days=3 * i)).strftime(form) for i in range(n)]


@pytest.fixture
def tables(spark):
    accounts = spark.createDataFrame([(f"a{i % 7}", str(i), f"{d} to {d}", "new", T + timedelta(hours=i)) for i, d in enumerate(days(90, "%m/%d/%Y"))], "doc_id string, account_number string, period string, source string, loaded_at timestamp")
    returns = spark.createDataFrame([("r", str(i), d, None, T + timedelta(hours=i)) for i, d in enumerate(days(40, "%d/%m/%Y"))], "doc_id string, acknowledgement_number string, date_of_filing string, source string, loaded_at timestamp")
    lines = spark.createDataFrame([], LINES)
    sources = spark.createDataFrame([], "source string, tz string, date_order string")
    return lines, accounts, returns, sources


def test_any_number_of_partitions(spark, tables):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = []
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({tuple(r) for r in read_dates(*tables).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got[0] == got[1]
    # no source is listed, so the chains alone find the order
    assert {r[4] for r in got[0] if r[0] == "account"} == set(days(90, "%Y-%m-%d")) and {r[4] for r in got[0] if r[0] == "return"} == set(days(40, "%Y-%m-%d"))


def test_a_source_of_many_records_is_cut(spark, tables, monkeypatch):
    monkeypatch.setattr(dates, "CHAIN", 20)
    assert {r.norm for r in read_dates(*tables).collect() if r.origin == "account"} == set(days(90, "%Y-%m-%d"))


@pytest.mark.parametrize("held", [7, 100_000])
def test_chains_go_over_held_rows_and_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(rejects, "BATCH", held)
    monkeypatch.setattr(statement_rows, "BLOCK", 64)
    printed = ["01/25/2022", *["02/%02d/2022" % (i // 9 + 1) for i in range(1, 99)]]
    rows = [("d", 0, HEAD, None, "bank_statement", T)] + [("d", i + 1, [p, "x", "", "", "1"], None, "bank_statement", T) for i, p in enumerate(printed)]
    none = spark.createDataFrame([], "source string, tz string, date_order string")
    got = {r.line_no: r.norm for r in load_statement_rows(spark.createDataFrame(rows, LINES), none).collect()}
    assert len(got) == 99 and all(got[i + 1].startswith("2022-02" if i else "2022-01-25") for i in range(64))
    raw = spark.createDataFrame([("d", i, ",", f"{p},x,,,1") for i, p in enumerate(printed)] * 2, "doc_id string, line_no int, delim string, raw_row string")
    got = {r.line_no: r.norm for r in load_raw_rows(raw).collect()}
    assert len(got) == 99 and all(got[i].startswith("2022-02" if i else "2022-01-25") for i in range(64))
