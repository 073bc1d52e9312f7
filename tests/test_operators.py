from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from paperlode.operators import answers, facts, grounding, ingest, layout, listing, retrieval, text

T = datetime(2024, 1, 1)
LINES = "doc_id string, line_no int, page int, text string, cells array<string>, loaded_at timestamp"


def statement(spark):
    row = lambda *c: list(c)
    rows = [
        (1, 1, "EXAMPLE BANK LTD", None), (2, 1, "Account Number : 1234567890", None), (3, 1, "Account Name : Asha Rao", None), (4, 1, "Statement period : 01/04/2021 to 30/06/2021", None), (5, 1, "IFSC: HDFC0123456", None),
        (6, 1, "", row("Date", "Narration", "Debit", "Credit", "Balance")), (7, 1, "", row("01/04/2021", "open", "", "100.00", "100.00")), (8, 2, "", row("05-Apr-2021", "rent", "40.00", "", "60.00")), (9, 2, "", row("05/04/2021", "fee", "10.00", "", "50.00")),
        (10, 2, "", row("01/01/1990", "bad year", "1", "", "49")), (11, 2, "", row("06/04/2021", "narrow", "1")), (12, 2, "Closing Balance : 55.00", None),
        (13, 3, "A/c No. 9999888877", None), (14, 3, "", row("Value Dt", "Txn Date", "Details", "Dr", "Cr", "Balance")), (15, 3, "", row("", "03/05/2021", "late", "", "5.00", "15.00")), (16, 3, "", row("", "02/05/2021", "early", "", "10.00", "10.00")),
    ]
    return spark.createDataFrame([("d", n, p, t, c, T) for n, p, t, c in rows] + [("e", 1, 1, "nothing here", None, T), (None, 1, 1, "x", None, T)], LINES)


def test_statement_facts(spark):
    got = {r.account_number: r for r in facts.statement_facts(facts.distinct_lines(statement(spark).unionByName(statement(spark)))).collect()}
    a, b = got["1234567890"], got["9999888877"]
    assert (a.page_start, a.page_end, b.page_start) == (1, 2, 3) and a.bank == "HDFC Bank" and a.holder == "Asha Rao" and a.period == "01/04/2021 to 30/06/2021"
    assert (a.transactions, a.first_transaction, a.last_transaction) == (3, date(2021, 4, 1), date(2021, 4, 5)) and a.closing_balance == Decimal("50.00") and a.total_debits == Decimal("50.00")
    assert a.row_check.startswith("100% of 2 rows") and a.statement_summary == {"closing_balance": "55"} and a.warnings == ["computed closing balance differ from the printed summary"]
    assert [x.narration for x in a.largest_debits] == ["rent", "fee"]
    assert b.closing_balance == Decimal("15.00") and b.row_check.startswith("100% of 1 rows") and b.holder is None


def test_returns(spark):
    rows = [
        ("r", 1, 1, "INDIAN INCOME TAX RETURN ITR-1 2021-22", None), ("r", 2, 1, "Acknowledgement Number : 123456789012", None), ("r", 3, 1, "PAN ABCDE1234F", None), ("r", 4, 1, "| 1 | Gross Total Income | 1 | 7,00,000 |", ["1", "Gross Total Income", "1", "7,00,000"]),
        ("r", 5, 2, "page of the same return", None), ("r", 6, 3, "Acknowledgement Number : 999999999999", None), ("r", 7, 3, "Total Income 5,00,000", None), ("x", 1, 1, "no return", None),
    ]
    got = facts.returns(facts.distinct_lines(spark.createDataFrame([(*r, T) for r in rows], LINES))).orderBy("return_no").collect()
    assert [(r.page_start, r.page_end, r.acknowledgement_number) for r in got] == [(1, 2, "123456789012"), (3, 3, "999999999999")]
    assert got[0].form == "ITR-1" and got[0].assessment_year == "2021-22" and got[0].pan == "ABCDE1234F" and got[0].amounts == {"gross_total_income": "7,00,000"}
    assert got[1].amounts == {"total_income": "5,00,000"}


def test_blocks_and_chunks(spark):
    md = "# A\n\nline one\nline two\n\n| h | v |\n|---|---|\n\n| a | 1 |\n## B ##\ntail"
    pages = spark.createDataFrame([("d", 2, "second page", "x"), ("d", 1, md, "x"), ("d", 1, md, "y"), ("d", 3, None, "x"), ("e", 1, "", "x")], "doc_id string, page_no int, md string, kind string")
    b = text.blocks(pages.drop("kind")).orderBy("page", "block").collect()
    assert [(r.page, r.kind, r.text) for r in b if r.doc_id == "d"] == [(1, "heading", "A"), (1, "text", "line one\nline two"), (1, "table", "| h | v |\n|---|---|\n| a | 1 |"), (1, "heading", "B"), (1, "text", "tail"), (2, "text", "second page")]
    c = text.chunks(text.blocks(pages.drop("kind"))).collect()
    assert len(c) == 1 and c[0].page_start == 1 and c[0].page_end == 2 and c[0].has_table and c[0].heading_path == ["A"]
    path = {(r.page, r.block): r.path for r in text.breadcrumbs(text.blocks(pages.drop("kind"))).collect() if r.doc_id == "d"}
    assert path[2, 1] == ["A", "B"]
    assert [r.text for r in text.lines(pages.drop("kind")).where("doc_id = 'd' and page = 1 and cells is not null").orderBy("pos").collect()] == ["| h | v |", "| a | 1 |"]
    assert text.assemble(pages.drop("kind")).where("doc_id = 'd'").first().markdown.startswith("<!-- page: 1 -->\n\n# A")


def test_folds():
    table = "| name | value |\n|---|---|\n" + "\n".join(f"| row {i} | {i}.00 |" for i in range(200))
    pieces = text.split_table(table, 300)
    assert all(text.cost(p) <= 320 and p.startswith("| name") for p in pieces) and sum(p.count("row ") for p in pieces) == 200
    assert text.split_table("", 10) == [""]
    long = " ".join(f"Sentence number {i} is here." for i in range(400))
    got = text.pack([("heading", "H", 1, 1), ("text", long, 1, 0)], 200, 50, 1000)
    assert all(text.cost(c["text"]) <= 220 and c["heading_path"] == ["H"] for c in got) and " ".join(c["text"] for c in got) == long
    small = [("heading", "A", 1, 1), ("text", "one", 1, 0), ("heading", "B", 2, 1), ("text", "two", 2, 0), ("heading", "C", 3, 1), ("text", "three", 3, 0)]
    assert [(c["page_start"], c["page_end"]) for c in text.pack(small, 500, 100)] == [(1, 3)]
    assert text.pack([("heading", "only", 1, 1)]) == [] and text.pack([]) == []


def test_retrieval(spark):
    d = spark.createDataFrame([(1, "the rent of the flat"), (2, "rent rent deposit"), (3, "nothing"), (4, None), (5, "")], "id int, text string")
    got = retrieval.bm25_topk(d, "id", "text", "What is the rent deposit?").collect()
    assert [r.id for r in got] == [2, 1]
    assert {r.bm25 for r in retrieval.bm25(d, "id", "text", "the of").collect()} == {0.0}
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 1.0], "b"), (4, None, "a"), (5, [0.0, 0.0], "a")], "id int, v array<double>, k string")
    assert [r.id for r in retrieval.nearest(v, "id", "v", [1.0, 0.1], 2).collect()] == [1, 3]
    assert [r.id for r in retrieval.nearest(v, "id", "v", [1.0, 0.1], 2, retrieval.where(k="a", none=None)).collect()] == [1, 2]
    h = retrieval.hybrid(d.withColumn("chunk_id", F.col("id").cast("string")).drop("id"), "rent deposit", k=2).collect()
    assert [r.chunk_id for r in h] == ["2", "1"] and h[0].score > h[1].score
    e = d.select(retrieval.hash_embedding(F.col("text")).alias("e")).collect()
    assert len(e[0].e) == 256 and abs(sum(x * x for x in e[0].e) - 1) < 1e-9 and sum(e[3].e) == 0
    cut = retrieval.budget_cut(d.where("text is not null"), [F.lit(1)], [F.col("id")], "text", 9).collect()
    assert [r.id for r in cut] == [1, 2] or [r.id for r in cut] == [1]


def test_grounding(spark):
    a = spark.createDataFrame([(1, "Costs rose to (1,200) [3] and 5 items, 7.5%"), (2, None)], "k int, text string")
    c = spark.createDataFrame([(1, "a decrease of 1,200")], "k int, text string")
    assert [r.raw for r in grounding.unverified(a, c, "k").collect()] == ["7.5%"]


def test_layout(spark):
    money = lambda s, right, top: {"text": s, "x0": right - 20, "x1": right, "top": top, "bottom": top + 8}
    word = lambda s, x, top: {"text": s, "x0": x, "x1": x + 5 * len(s), "top": top, "bottom": top + 8}
    words = [word("Date", 20, 10), word("Details", 80, 10), money("Debit", 300, 10), money("Credit", 380, 10), money("Balance", 480, 10)]
    bal = 100.0
    for i in range(6):
        bal += 10
        y = 30 + 20 * i
        words += [word(f"{i + 1:02d}/04/2021", 20, y), word("pay", 80, y), money("10.00", 380, y), money(f"{bal:.2f}", 480, y), word("wrapped", 80, y + 9)]
    labels, table = layout.unruled_table(words)
    assert labels == ["Date", "Details", "Debit", "Credit", "Balance"] and table[0] == ["01/04/2021", "pay wrapped", "", "10.00", "110.00"] and len(table) == 6
    broken = [dict(w, text="999.00") if w["text"] in ("120.00", "140.00", "150.00") else w for w in words]
    assert layout.unruled_table(broken) is None and layout.unruled_table([]) is None
    d = spark.createDataFrame(pd.DataFrame([{"doc_id": "d", "page_no": 1, "word_no": i, **w} for i, w in enumerate(words)]))
    assert layout.unruled_tables(d).count() == 7
    assert layout.line_numbers(d).agg(F.max("line_no")).first()[0] == 12
    assert layout.split_merged_row([[(1.0, "a"), (9.0, "b")], [(1.0, "x"), (5.0, "y"), (9.0, "z")], []]) == [["a", "x y", ""], ["b", "z", ""]] and layout.split_merged_row([[(1.0, "a")]]) is None
    m = spark.createDataFrame([([["h", "", "v"], ["", "", ""], ["1"]],), ([],)], "r array<array<string>>").select(layout.to_markdown(F.col("r")).alias("m")).collect()
    assert m[0].m == "| h | v |\n|---|---|\n| 1 |  |" and m[1].m is None


def test_ingest(spark):
    p = spark.createDataFrame([("d", n) for n in (1, 2, 3, 5, 6, 9, 9)], "doc_id string, page_no int")
    assert sorted((r.first, r.last) for r in ingest.page_runs(p).collect()) == [(1, 3), (5, 6), (9, 9)]
    k = spark.createDataFrame([("d", n, "digital") for n in range(1, 52)] + [("s", n, "scanned") for n in range(1, 11)], "doc_id string, page_no int, kind string")
    got = ingest.plan_shards(k).collect()
    assert sorted(r.end - r.start + 1 for r in got if r.doc_id == "d") == [12, 13, 13, 13] and sorted(r.end - r.start + 1 for r in got if r.doc_id == "s") == [2, 2, 3, 3]
    f = spark.createDataFrame([("x", 1, "a"), ("y", 2, "b"), ("x", 3, "c")], "doc_id string, pos int, name string")
    assert {r.name: r.error for r in ingest.duplicates(f).collect()} == {"a": None, "b": None, "c": "duplicate of a"}
    stats = spark.createDataFrame([(5, 0.0, 0.0), (500, 0.9, 0.0), (500, 0.0, 0.8), (500, 0.0, 0.1)], "text_chars int, garbage_ratio double, image_coverage double")
    assert [r.kind for r in ingest.triage(stats).collect()] == ["scanned", "scanned", "hybrid", "digital"]
    images = spark.createDataFrame([("d", 1, 0.0, 10.0, 0.0, 5.0, 0), ("d", 1, 0.0, 10.0, 0.0, 10.0, 200)], "doc_id string, page_no int, x0 double, x1 double, y0 double, y1 double, overlaid_chars int")
    assert ingest.image_coverage(images, F.lit(100.0)).first().image_coverage == 0.5
    assert ingest.fingerprint(a=1, b=2) == ingest.fingerprint(b=2, a=1) != ingest.fingerprint(a=2, b=1)


def test_answers_and_listing(spark):
    q = spark.createDataFrame([("closing balance of accounts",), ("why is it so",), ("total income",), ("hello",), ("bank and pan",)], "q string")
    assert [r.x for r in q.select(answers.intent(F.col("q")).alias("x")).collect()] == ["bank", "model", "tax", "none", "both"]
    lines = facts.distinct_lines(statement(spark))
    f = facts.statement_facts(lines)
    names = spark.createDataFrame([("d", "file.pdf")], "doc_id string, source string")
    shown = answers.bank_tables(f, names).first().answer
    assert shown.startswith("**file.pdf** has **2 accounts**:") and "| HDFC Bank | 1234567890 | Asha Rao |" in shown and "55 (printed)" in shown
    told = answers.rendered_accounts(f, names).first().text
    assert told.startswith("file.pdf:\n  2 account(s) in this file\n  1. HDFC Bank a/c 1234567890; pages 1-2; holder: Asha Rao; period: 01/04/2021 to 30/06/2021; transactions: 3; first transaction: 01 Apr 2021;")
    assert "printed summary: closing balance 55; computed closing balance: 50;" in told and "\n     largest debits: 40 on 05 Apr 2021 (rent); 10 on 05 Apr 2021 (fee)" in told and "\n     WARNING: computed closing balance" in told and "\n  2. " in told
    assert "| HDFC Bank …7890 | 05 Apr 2021 | 40 | rent |" in answers.largest_table(f, "largest_debits").first().answer
    t = listing.with_type(spark.createDataFrame([("itr",), (None,), ("odd",)], "doc_type string"), listing.doc_types(spark))
    assert sorted(r.type_label for r in t.collect()) == ["Income tax return", "Other document", "Other document"]
