from __future__ import annotations

import math
import random
import re

import pytest

from paperlode.llm import splitting


def cost(text: str) -> int:
    return sum(math.ceil(len(g) / 4) if g[0].isalpha() and g[0].isascii() else 1 for g in re.findall(r"[A-Za-z]+|[^A-Za-z\s]", text))


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(4, 15))).capitalize() + ". "
    yield "prose", "\n\n".join("".join(sentence() for _ in range(6)) for _ in range(25)), False
    yield "table", "| h | v |\n|---|---|\n" + "\n".join(f"| {word()} | {r.randint(0, 99999)} |" for _ in range(700)), True
    yield "letters", "x" * 9000, False
    yield "digits", "7" * 3000, False
    yield "marks", "".join(f"<!-- page: {n} -->\n" + "".join(sentence() for _ in range(9)) + "\n" for n in range(4, 16)), None
    yield "blank", " " * 5000, False
    yield "small", "a few words", False
    yield "hindi", "यह भूमि ग्राम में स्थित है। " * 80, False


@pytest.mark.parametrize("size", [997, 32_768])
def test_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(splitting, "RANGE", size)
    monkeypatch.setattr(splitting.ranges, "__defaults__", (size, 700))
    rows = [(k, t, ["H"], 3 if k == "marks" else None, 9, h, "clash") for k, t, h in texts()]
    rows += [rows[0], ("none", None, None, 1, 1, False, "x"), (None, "x", None, 1, 1, False, "x"), ("empty", "", [], 1, 1, True, "x")]
    d = spark.createDataFrame(rows, "chunk_id string, text string, heading_path array<string>, page_start int, page_end int, has_table boolean, piece_no string")
    known = {k: (t, splitting.TABLE_LIMIT if h else splitting.LIMIT) for k, t, h in texts()}
    totals = {r.chunk_id: r.total for r in splitting.costs(d).collect()}
    assert totals == {k: cost(t) for k, (t, _) in known.items()} | {"empty": 0}
    by: dict[str, list] = {}
    for r in splitting.pieces(d).orderBy("chunk_id", "piece_no").collect():
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == {k for k, (t, most) in known.items() if cost(t) > most} == {r.chunk_id for r in splitting.oversized(d).collect()}
    for k, pieces in by.items():
        text, most = known[k]
        at = 0
        for n, p in enumerate(pieces):
            assert p.piece_no == n and p.text == text[p.char_start : p.char_end] and p.heading_path == ["H"]
            assert cost(p.text) <= most and p.char_start <= at < p.char_end
            assert cost(text[p.char_start : at]) == p.overlap_tokens <= splitting.OVERLAP
            at = p.char_end
        assert at == len(text)
    prose = by["prose"]
    assert all(re.search(r"\.\s*$", p.text) for p in prose)
    marks = by["marks"]
    assert marks[0].page_start == 4 and marks[-1].page_end == 15 and all(a.page_end <= b.page_end for a, b in zip(marks, marks[1:], strict=False))
    assert by["letters"][0].page_start is None


def test_empty(spark):
    d = spark.createDataFrame([], "chunk_id string, text string, heading_path array<string>, page_start int, page_end int, has_table boolean")
    assert splitting.pieces(d).count() == 0 and splitting.oversized(d).count() == 0
