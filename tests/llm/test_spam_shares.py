"""The shares of a page, its language, and the calibration of the thresholds."""

from __future__ import annotations

import numpy as np

from paperlode.llm import spam

PROSE = "The lessee shall pay a monthly rent of Rs. 9,000 on or before the 5th day of each month. No encumbrance is found on the land. "


def test_language_is_told_from_the_whole_text():
    links = "http://x.example/a " * 400
    assert spam.language("hi", links + "यह भूमि सर्वेक्षण की है। " * 900, []) == "hi"
    assert spam.language("HI", PROSE, PROSE.lower().split()) == "en"
    assert spam.language("Deutsch", "Die Miete ist im Voraus zu zahlen", "die miete ist im voraus zu zahlen".split()) == "de"
    assert spam.language(None, "", []) == "un" and spam.language("??", "12 34", []) == "un"


def test_every_share_has_its_part():
    usual = spam.prior("en")
    base = {f: np.array([usual[f][1]]) for f in spam.PRIOR} | {"numbers": np.array([0.0])}
    assert not spam.stuffed(base, usual)[0]
    assert spam.stuffed(base | {"links": np.array([0.9])}, usual)[0]
    strong = {"top_word": 0.7, "ngrams": 1.0, "dup_lines": 1.0, "separators": 0.6, "function_words": 0.0}
    assert spam.stuffed(base | {f: np.array([v]) for f, v in strong.items()}, usual)[0]
    for f in strong:  # one alone never decides, records never count
        assert not spam.stuffed(base | {f: np.array([strong[f]])}, usual)[0]
    assert not spam.stuffed(base | {f: np.array([v]) for f, v in strong.items()} | {"numbers": np.array([0.5])}, usual)[0]


def test_thresholds_follow_the_language():
    repeated = {f: (a, b, c) for f, (a, b, c) in spam.prior("de").items()} | {"ngrams": (0.5, 0.65, 0.8)}
    shares = {"top_word": np.array([0.4]), "ngrams": np.array([0.68]), "dup_lines": np.array([0.25]), "links": np.array([0.0]), "separators": np.array([0.14]), "function_words": np.array([0.29]), "numbers": np.array([0.0])}
    assert spam.stuffed(shares, spam.prior("de"))[0] and not spam.stuffed(shares, spam.calibrated("de", repeated, 5000))[0]


def test_long_and_odd_texts():
    for t in ("[" * 200_000, "<a " * 60_000, "a: " * 60_000, "#" * 100_000, "\x00" * 50_000, "x" * 300_000):
        assert 0 <= spam.features(t)["stuffed"] <= 1
