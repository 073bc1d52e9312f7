from __future__ import annotations

import pytest

from paperlode.llm import scans

BODY = [
    "The vendor conveys the property to the purchaser for the agreed price",
    "and the purchaser has paid the entire consideration in instalments.",
    "Depreciation on plant and machinery has been charged on the usual basis",
]


@pytest.fixture
def tables(spark):
    pages = []
    for d in range(30):
        for n in (1, 2, 3):
            text = [BODY[k % 3] for k in range(8)]
            pages.append((f"d{d}", n, "\n".join(["DEED OF SALE    Page %d of 3" % n, "", *text[:4], "", *text[4:], "", "Confidential"]), "x"))
    noisy = "\n".join(["DEED 0F SALE    Page 1 of 2", "", "The vendor conveys the pr0perty to the purchascr for the agreed pri-", "ce on 2O21-04-01 of Rs. 1,S81.92 and the entire consi¬", "", "- 1 -"])
    after = "\n".join(["DEED OF SALE    Page 2 of 2", "deration in instalments.", "", "# Heading", "- 2 -"])
    pages += [("n", 1, noisy, "x"), ("n", 1, noisy, "y"), ("n", 2, after, "x"), ("n", 3, None, "x"), ("n", 4, "", "x"), ("n", 5, " \n ", "x"), (None, 1, "x", "x"), ("one", 1, "A" * 50_000, "x")]
    shards = [("s", 0, "scanned", 1, 1, [], "exception", "no", [1], "clash"), ("s", 0, "scanned", 1, 1, [(1, BODY[0] + "\n7")], "success", None, [], "clash")]
    return (
        spark.createDataFrame(pages, "doc_id string, page_no int, md string, kind string"),
        spark.createDataFrame(shards, "doc_id string, shard_no int, kind string, page_start int, page_end int, pages array<struct<page_no:int,md:string>>, status string, error string, fallback array<int>, fixed string"),
    )


def test_repairs(tables):
    got = {tuple(r) for r in scans.repairs(*tables).collect()}
    n = {r[1:] for r in got if r[0] == "n"}
    assert {(1, 3, "ocr", "property"), (1, 3, "ocr", "purchaser"), (1, 3, "hyphen", "price"), (1, 4, "ocr", "2021-04-01"), (1, 4, "ocr", "1,581.92"), (1, 4, "hyphen", "consideration"), (1, 1, "header", ""), (1, 6, "page_number", ""), (2, 1, "header", ""), (2, 5, "page_number", "")} == n
    d = {r[1:] for r in got if r[0] == "d7"}
    assert d == {(n, line, "header", "") for n in (1, 2, 3) for line in (1, 13)}
    assert not [r for r in got if r[0] in (None, "one")]


def test_paragraphs(tables):
    got = {(r.page_no, r.para_no): r.text for r in scans.paragraphs(*tables).where("doc_id = 'n'").collect()}
    assert got[1, 0] == "The vendor conveys the property to the purchaser for the agreed price on 2021-04-01 of Rs. 1,581.92 and the entire consideration in instalments."
    assert "# Heading" in got.values() and len(got) == 2


def test_empty(spark, tables):
    assert scans.repairs(tables[0].limit(0), tables[1].limit(0)).count() == 0


@pytest.mark.parametrize(
    ("word", "want"),
    [("1,S81.92", "1,581.92"), ("2O19", "2019"), ("16,63,47l.66", "16,63,471.66"), ("INV/2O/4129", "INV/20/4129"), ("D0C/21/8056S", "DOC/21/80565"), ("01/01/2021", None), ("12/11/2020", None), ("8th", None), ("B4", None), ("house", None), ("5B", None)],
)
def test_numbers(word, want):
    assert scans.number(word) == want


def test_suspects_undo_every_mark():
    assert ("collected", 1) in scans.suspects("col1ected") and ("Follow", 2) in scans.suspects("Follovv") and ("modern", 2) in scans.suspects("rnodern")
    assert scans.suspects("") == [] and scans.suspects("x@y.z") == []
    assert all(not any(c in "01569!" for c in w) for w, _ in scans.suspects("c0l1ect"))


def test_model_sums_to_one():
    import math

    m = scans.model({("shape", "body", "full"): 10.0})
    assert abs(sum(math.exp(v) for (t, s, _), v in m.items() if (t, s) == ("shape", "body")) - 1) < 0.01
