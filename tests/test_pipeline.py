from __future__ import annotations

import io
import json

from paperlode.cli import main
from paperlode.plans.pipeline import NOTHING, Library

STATEMENT = "EXAMPLE BANK\nAccount Number : 1234567890\n| Date | Narration | Debit | Credit | Balance |\n|---|---|---|---|---|\n| 01/04/2021 | open |  | 100.00 | 100.00 |\n| 05/04/2021 | rent | 40.00 |  | 60.00 |\f# Notes\nThe monthly rent of the flat is 9,500.\n"


def test_library(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_text(STATEMENT)
    (folder / "copy.pdf").write_text(STATEMENT)
    lib = Library(spark, str(tmp_path / "lib"))
    assert [e["text"] for e in lib.ask("rent of the flat")] == [NOTHING]
    report = {r.name: r for r in lib.ingest(str(folder), doc_type="bank_statement").collect()}
    assert sorted(r.status for r in report.values()) == ["done", "skipped"] and max(r.pages for r in report.values()) == 2
    assert {r.status for r in lib.ingest(str(folder)).collect()} == {"skipped"}
    assert [(r.chunks, r.category) for r in lib.listing().collect()] == [(1, "finance")]
    (quick,) = lib.ask("What is the closing balance of each account?")
    assert quick["route"] == "facts" and "| 1234567890 |" in quick["text"] and "| 60 |" in quick["text"]
    events = list(lib.ask("Explain the rent of the flat", model=lambda m: iter(["It is 9,500", " or 7,777 [1]."])))
    assert [e["event"] for e in events] == ["prepared", "token", "token", "answer"] and events[-1]["unverified"] == ["7,777"] and events[-1]["route"] == "finance"
    assert list(lib.ask("Explain", category="property"))[0]["text"] == NOTHING
    out = io.StringIO()
    assert main(["--data-dir", str(tmp_path / "lib"), "stats"], spark, out) == 0 and json.loads(out.getvalue())["chunks"] == 1
    out = io.StringIO()
    assert main(["--data-dir", str(tmp_path / "lib"), "triage", str(folder / "a.pdf")], spark, out) == 0 and '"kind": "digital"' in out.getvalue()
    out = io.StringIO()
    assert main(["--data-dir", str(tmp_path / "lib"), "parse", str(folder / "a.pdf")], spark, out) == 0 and out.getvalue().startswith("<!-- page: 1 -->")
