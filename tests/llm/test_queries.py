"""Every query of the subpackage runs on the smallest tables with a stable schema."""

from __future__ import annotations

import pytest

from paperlode.llm import queries

COLUMNS = {
    "p2_found": ["doc_id", "page_no", "line_in_page", "kind", "fixed"], "p3_found": ["origin", "doc_id", "seq", "pii_type", "pii_value"], "p4_found": ["chunk_id"], "p5_found": ["vec_a", "vec_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["item_id", "doc_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows and df.columns == COLUMNS.get(name, df.columns)
    if name in COLUMNS:
        assert len({repr(r) for r in rows}) == len(rows)
