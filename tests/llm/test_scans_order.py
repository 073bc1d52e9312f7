"""Words that go on over pages without text, over many pages, and words with many doubtful characters."""

from __future__ import annotations

import pytest

from paperlode.llm import scans

LINE = "The vendor conveys the property to the purchaser for the agreed price and the whole consideration."


@pytest.fixture
def tables(spark):
    body = "\n".join([LINE] * 6)
    pages = [("a", 1, body + "\nThe vendor conveys the consid-"), ("a", 2, " \n"), ("a", 6, ""), ("a", 9, "eration to the purchaser.\n" + body)]
    pages += [("b", scans.BLOCK - 1, body + "\nand the prop-"), ("b", 3 * scans.BLOCK + 5, "erty is conveyed.\n" + body), ("c", 1, body + "\nand the prop-")]
    pages += [(f"d{i}", 1, body) for i in range(20)]
    return (
        spark.createDataFrame([(*p, "x") for p in pages], "doc_id string, page_no int, md string, fixed string"),
        spark.createDataFrame([], "doc_id string, shard_no int, pages array<struct<page_no:int,md:string>>"),
    )


def test_words_go_on_at_the_next_page_with_text(tables):
    got = {tuple(r) for r in scans.repairs(*tables).collect()}
    assert {r for r in got if r[3] == "hyphen"} == {("a", 1, 7, "hyphen", "consideration"), ("b", scans.BLOCK - 1, 7, "hyphen", "property")}


def test_the_right_half_stands_once(tables):
    got = sorted((r.page_no, r.para_no, r.text) for r in scans.paragraphs(*tables).where("doc_id = 'a'").collect())
    text = " ".join(t for *_, t in got)
    assert text.count("consideration to the purchaser.") == 0 or "eration to" not in text.replace("consideration to", "")
    assert text.split().count("eration") == 0 and "consideration" in got[0][2]


def test_words_with_many_marks():
    assert ("million", 1) in scans.suspects("mi11i0n") and any(w == "possession" for w, _ in scans.suspects("po55e55ion"))
    assert any(w == "Mississippi" for w, _ in scans.suspects("Mi55i55ippi"))
    assert scans.suspects("x" * 100_000) == []
