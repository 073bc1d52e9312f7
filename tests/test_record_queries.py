"""The queries of whole records, against the queries of their fields."""

from __future__ import annotations

import pytest

from paperlode.plans import catalog


@pytest.fixture(scope="module")
def fields(spark, data):
    return {(r.doc_id, r.account_number): r for r in catalog.QUERIES["account_fact_fields"](spark, data).collect()}


def test_records(spark, data, fields):
    got = {(r.doc_id, r.account_number): r for r in catalog.QUERIES["statement_facts"](spark, data).collect()}
    assert set(got) == set(fields) and all(got[k][c] == r[c] for k, r in fields.items() for c in r.asDict())
    assert all(len(r.largest_debits or []) <= 3 and all(r.warnings) for r in got.values())


def test_returns(spark, data):
    got = catalog.QUERIES["return_facts"](spark, data).collect()
    forms = {(r.doc_id, r.return_no): (r.form, r.date_of_filing) for r in catalog.QUERIES["return_form_fields"](spark, data).collect()}
    assert {(r.doc_id, r.return_no): (r.form, r.date_of_filing) for r in got} == forms and any(r.amounts for r in got)


def test_answers_name_every_account(spark, data, fields):
    told = {r.doc_id: r.answer for r in catalog.QUERIES["quick_bank_answers"](spark, data).collect()}
    assert set(told) == {d for d, _ in fields} and all(f"| {number} |" in told[d] for d, number in fields)


@pytest.mark.parametrize("name", ["quick_return_answers", "fact_summaries", "facts_rendered"])
def test_one_text_a_document(spark, data, name):
    rows = catalog.QUERIES[name](spark, data).collect()
    texts = [r[c] for r in rows for c in r.asDict() if c != "doc_id"]
    assert rows and all(texts) and (name == "facts_rendered" or len({r.doc_id for r in rows}) == len(rows))
