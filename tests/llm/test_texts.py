"""Token ids, leaks and stuffed pages."""

from __future__ import annotations

import os
import random
import re

import pytest

from paperlode.llm import leaks, spam, tokens
from paperlode.llm.queries import TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
ODD = ["", None, " ", "Hello world!", "<|endoftext|> is text", "a" * 3000, "aaaa bbbb   \n\n  c", "यह भूमि है।", "​﻿\x00é", "don't I'll", "1234567 12,34", "  lead", "x\t\ty", "🙂🙂 ok", "\r\n\r\n"]


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabularies here")
def test_token_ids(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    texts = ODD + ["".join(r.choice("abcde ,.\nABक१") for _ in range(r.randint(1, 400))) for _ in range(60)]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "", "x")], "doc_id bigint, text string, ids string")
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = tokens.token_ids(d, RANKS).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert list(row.ids) == t.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
    assert tokens.token_ids(d.limit(0), RANKS).count() == 0


def test_leaks(spark, monkeypatch):
    item = " ".join(f"Word{i}" for i in range(20))
    items = [(1, item), (2, " ".join(f"Word{i}" for i in range(5, 30))), (3, "too short to match"), (4, None), (None, item)]
    docs = [
        (1, "before. " + ", ".join(f"WORD{i}" for i in range(13)) + " after"), (2, " ".join(f"word{i}" for i in range(12)) + " gap word12"), (3, None), (4, ""), (5, f"x {item}! y {item}"), (6, "xWord0 " + " ".join(f"Word{i}" for i in range(1, 13))),
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (8_000_000, 10):  # one automaton, and many
        monkeypatch.setattr(leaks, "AUTOMATON", limit)
        got = leaks.leaked(d, e).collect()
        assert {(r.item_id, r.doc_id) for r in got} == {(1, 1), (1, 5), (2, 5)}
        one = next(r for r in got if r.doc_id == 1)
        assert docs[0][1][one.char_start : one.char_end].startswith("WORD0,") and docs[0][1][one.char_start : one.char_end].endswith("WORD12") and one.words == 13
        assert sorted(r.words for r in got if (r.item_id, r.doc_id) == (1, 5)) == [20, 20]
    assert leaks.leaked(d, e.limit(0)).count() == 0 and leaks.leaked(d.limit(0), e).count() == 0


PROSE = "The lessee shall pay a monthly rent of Rs. 9,000 on or before the 5th day of each month. No encumbrance is found on the land. "
SPAM = [
    "home loan, gold loan rate, home loan, home loan, gold loan rate, " * 8, "home loan\ngold loan\n" * 20, "होम लोन / गोल्ड लोन / होम लोन / " * 9, "\n".join(f"Place{'abc'[i % 3]}: https://rent-{i}.example/p/{i}" for i in range(12)),
    " ".join(f'<a href="www.x{i}.test/go">Town</a>' for i in range(12)), "\n".join(f"- [Town](http://x{i}.invalid/p)" for i in range(12)), "\n".join("Tags: cement, paint, home loan, timber" for _ in range(9)), "Paint > Timber > Home Loan > Cotton Yarn > Paint > Cement > Steel Rods",
    PROSE + "\n" + "tax refund fast tax refund fast\n#tax_refund #taxrefund\nhttp://tax-a.test/1\n" * 9,
]
FINE = [
    PROSE * 5, "", None, " \n ", PROSE * 3 + "\nReferences\n[1] https://archive-a.example/doc/1\n[2] https://archive-b.example/doc/2", "| Date | Payee | Amount |\n|---|---|---|\n" + "| 01/02/2021 | Home Loan | 1,000 |\n" * 20,
    "\n".join(f"{w}: the meaning of {w} as it is used in this deed." for w in ("Lessor", "Lessee", "Term", "Rent")), "विक्रेता ने संपूर्ण प्रतिफल प्राप्त कर लिया है। " * 9, "x",
]


def test_spam(spark):
    rows = [(i, t, "en") for i, t in enumerate(SPAM)] + [(100 + i, t, None) for i, t in enumerate(FINE)] + [(200 + i, PROSE * (i % 4 + 1), "EN") for i in range(40)] + [(0, SPAM[0], "en")]
    d = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, lang string, links double")
    got = spam.scored(d).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.stuffed_page} == set(range(len(SPAM)))
    assert spam.scored(d.limit(0)).count() == 0


def test_spam_features_are_shares():
    for t in [*SPAM, *FINE, "#a " * 5000, "a:b:c: " * 3000 + "http://x.test"]:
        assert all(0 <= v <= 1 for v in spam.features(t).values())
    assert re.fullmatch("0.0|0", str(spam.features(None)["stuffed"]))
