"""Sections of many lines: blocks give what one window over the section gives."""

from __future__ import annotations

from datetime import datetime

from paperlode.operators import facts, statement_rows

T = datetime(2024, 1, 1)


def test_blocks_change_nothing(spark, monkeypatch):
    head = ["Date", "Narration", "Debit", "Credit", "Balance"]
    rows = [("d", 0, 1, "Account Number : 1234567890", None), ("d", 1, 1, "Statement period 01/01/2021 to 31/12/2021", None), ("d", 2, 1, None, head)]
    balance = 500.0
    for i in range(60):
        balance -= i % 3
        rows.append(("d", 3 + i, 1 + i // 20, None, [f"{i // 3 + 1:02d}/03/2021", f"n{i}", str(i % 3) if i % 3 else "", "", f"{balance:.2f}"]))
    rows += [("d", 70, 4, None, ["Date", "Narration", "Credit", "Debit", "Balance"]), ("d", 71, 4, None, ["25/03/2021", "swap", "5.00", "", f"{balance + 5:.2f}"]), ("d", 72, 4, None, ["bad", "x", "", "", ""])]
    lines = facts.distinct_lines(spark.createDataFrame([(*r, T) for r in rows], "doc_id string, line_no int, page int, text string, cells array<string>, loaded_at timestamp"))

    def run():
        tx = facts.transactions(facts.section_lines(lines, facts.sections(lines)))
        return sorted(map(tuple, tx.collect())), [tuple(r) for r in facts.row_check(tx).collect()]

    whole = run()
    assert len(whole[0]) == 61 and [r[-1] for r in sorted(whole[0], key=lambda r: r[2])] == list(range(1, 62)) and whole[0][-1][5] is not None
    monkeypatch.setattr(statement_rows, "BLOCK", 4)
    assert run() == whole


def test_newest_first(spark, monkeypatch):
    head = ["Date", "Narration", "Debit", "Credit", "Balance"]
    rows = [("d", 0, 1, "Account Number : 1234567890", None), ("d", 1, 1, None, head)] + [("d", 2 + i, 1, None, [f"{20 - i // 2:02d}/03/2021", f"n{i}", "", "1", "1"]) for i in range(10)]
    lines = facts.distinct_lines(spark.createDataFrame([(*r, T) for r in rows], "doc_id string, line_no int, page int, text string, cells array<string>, loaded_at timestamp"))
    monkeypatch.setattr(statement_rows, "BLOCK", 3)
    tx = facts.transactions(facts.section_lines(lines, facts.sections(lines))).orderBy("seq").collect()
    assert [r.narration for r in tx] == [f"n{i}" for i in range(9, -1, -1)]
    assert facts.transactions(facts.section_lines(lines.limit(0), facts.sections(lines))).count() == 0
