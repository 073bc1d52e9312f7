"""Nothing is cut at a number of characters, and every number after a cue is taken."""

from __future__ import annotations

import time

import pytest

from paperlode.llm import pii

ANCHORS = pii.automaton()


def kinds(text):
    return [(k, text[a:b]) for a, b, k in pii.find(text, ANCHORS)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"Write to {'a' * 70}@mail.example today", [("email", "a" * 70 + "@mail.example")]),
        ("Reach 98765 43210 any time", [("phone", "98765 43210")]),
        ("The number ABCDE1234F belongs to the owner", [("id_number", "ABCDE1234F")]),
        ("Please call 98765 43210 or, after six in the evening and on holidays, 98765 43211.", [("phone", "98765 43210"), ("phone", "98765 43211")]),
        ("Aadhaar of the first holder, as it is recorded in the register of the said institution: 123456789012", [("id_number", "123456789012")]),
        ("NEFT S. Iltel RENT | 5", [("name", "S. Iltel")]),
        ("Payment was collected from Pava A. Jotch, Flat 5C, Ashyo Avenue, Tovash - 044 232.", [("name", "Pava A. Jotch"), ("address", "Flat 5C, Ashyo Avenue, Tovash - 044 232")]),
        ("He resides at 12, " + "North " * 40 + "Road, Pune - 411 001.", [("address", "12, " + "North " * 40 + "Road, Pune - 411 001")]),
        ("ref/98765-43210 is a code", []),
        ("The invoice 98765 43210 was paid. Account 123456789012", [("phone", "98765 43210")][:0]),
    ],
)
def test_probes(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("unit", ["@", "a@b.example ", "12, Long Road, Pune ", "call 123456789012 ", "PAN 123456789012 ", "Mr. A ", "98765 43210 ", "((((", "Road Road ", "5 Road 560001 "])
def test_time_grows_with_the_length(unit):
    took = []
    for size in (40_000, 160_000):
        t = time.process_time()
        pii.find(unit * (size // len(unit)), ANCHORS)
        took.append(time.process_time() - t)
    assert took[1] < 10 * max(took[0], 0.05)
