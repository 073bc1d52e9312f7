"""Every cell is read, however long it is."""

from __future__ import annotations

from decimal import Decimal

from paperlode.plans import catalog

LONG = "30.Mar.2021 00:49 UTC+04:00 INT.PD 9825.90 56036.75"
CELLS = {
    LONG: (None, Decimal("30")),
    "CHQ PAID TO TELVAN (1,234.50) Dr": (None, Decimal("-1234.50")),
    "( 1 , 2 3 4 , 5 6 7 . 8 9 ) ": (Decimal("-1234567.89"), Decimal("-1234567.89")),
    "          12,34,567.50 Dr": (Decimal("-1234567.50"), Decimal("-1234567.50")),
    "12.50": (Decimal("12.50"), Decimal("12.50")),
    "NEFT Endrenal Naltch RENT": (None, None),
    "२६/०१/२०२१": (None, Decimal("26")),
    "१,२३४.५०": (Decimal("1234.50"), Decimal("1234.50")),
    "": (None, None),
}


def test_cells_of_any_length(spark, tmp_path):
    spark.createDataFrame([([*CELLS, None],), (None,), ([LONG],)], "cells array<string>").write.parquet(f"{tmp_path}/doc_lines.parquet")
    amounts = {r.printed: r.amount for r in catalog.QUERIES["amounts_all"](spark, str(tmp_path)).collect()}
    numbers = {r.cell: r.number for r in catalog.QUERIES["cells_signed_all"](spark, str(tmp_path)).collect()}
    assert amounts == {k: v[0] for k, v in CELLS.items()}
    assert numbers == {k: v[1] for k, v in CELLS.items()}
