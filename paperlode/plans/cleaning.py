"""Queries of the core's operators for training data: dates (p1) and rows that fail to parse (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlode.operators.dates import read_dates
from paperlode.operators.rejects import load_raw_rows, load_statement_rows
from paperlode.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every date read in doc_lines, bank_accounts and tax_returns."""
    return read_dates(table(spark, d, "doc_lines"), table(spark, d, "bank_accounts"), table(spark, d, "tax_returns"), table(spark, d, "sources"))


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    lines = load_statement_rows(table(spark, d, "doc_lines"), table(spark, d, "sources"))
    return lines.unionByName(load_raw_rows(table(spark, d, "raw_rows")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every row that cannot be loaded, with one reason."""
    return _loaded(spark, d).where("reason is not null").select("origin", "doc_id", "line_no", "reason").distinct()


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row that loads, as typed values."""
    return _loaded(spark, d).where("reason is null").drop("reason")


QUERIES = {"p1_found": p1_found, "p6_found": p6_found, "p6_rows": p6_rows}
ORACLES: dict[str, str] = {}
