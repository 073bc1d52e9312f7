"""Numbers without a cue word, and every number after one."""

from __future__ import annotations

import pytest

from paperlode.llm import pii

CASES = [
    ("G. Telvan may be called on 57071-40973.", ["57071-40973"]),
    ("and may be called on 646-555-0182.\n\nNext", ["646-555-0182"]),
    ("may be called on 07700 900 894", ["07700 900 894"]),
    ("PONTCH@MAIL.EXAMPLE.NET / 646-555-0110", ["PONTCH@MAIL.EXAMPLE.NET", "646-555-0110"]),
    ("Contact 57071-40973, 646-555-0182 or (212) 555-0109", ["57071-40973", "646-555-0182", "(212) 555-0109"]),
    ("Holder APZXT8078L, then 0551 0423 4900 and X0915968.", ["APZXT8078L", "0551 0423 4900", "X0915968"]),
    ("PAN APZXT8078L and BPZXT8078M of the holders", ["APZXT8078L", "BPZXT8078M"]),
    ("Order no. 9547285052, Voucher 4000-1234-7079, GSTIN 27KBFZD4167K1Z5, UTR 5332687272780315", []),
    ("B/8859770169/C77A and 4C83/D7158808/AE21 and A/787F/996862667355/5924", []),
    ("A/c XXXX1234 with card 4000 1234 7079 1111 from 01/02/2021 to 2021-03-04, 3,71,191.24", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_find(text, want):
    spans = pii.find(text, pii.automaton())
    assert [text[a:b] for a, b, _ in spans] == want
    assert all(v not in pii.redact(text, spans) for v in want)
