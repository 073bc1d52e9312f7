"""Keyword pages whose phrases end like sentences."""

from __future__ import annotations

import pytest

from paperlode.llm import spam

PROSE = "The lessee shall pay a monthly rent of Rs. 9,000 on or before the 5th day of each month. No encumbrance is found on the land. "
ENDS = ("top.", "cheap!", "2024.", "call now!", "best", "call now.")
KEYS = {"en": ("home loan", "gold loan rate", "flat on rent"), "hi": ("होम लोन", "सस्ता लोन", "किराये का फ्लैट")}


def page(keys, n=40):
    return " ".join(f"{keys[i * i % 3]} in {('Galeygaon', 'Xemekot')[i // 2 % 2]} {ENDS[i % 6]}" for i in range(n))


@pytest.mark.parametrize("lang", sorted(KEYS))
def test_key_phrases_with_full_stops(spark, lang):
    rows = [(1, page(KEYS[lang]), lang), (2, PROSE + "\n\n" + page(KEYS[lang]), lang), (3, PROSE * 30 + "\n\n" + page(KEYS[lang], 8), lang)]
    rows += [(100 + i, PROSE * (i % 4 + 1), lang) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in spam.scored(d).collect() if r.stuffed_page} == {1, 2}


@pytest.mark.parametrize(
    "text",
    [
        "\n".join(f"Rent for {m} 2021 was received in full on {i + 1} {m} 2021." for i, m in enumerate("January February March April May June July August September October".split())),
        "विक्रेता ने संपूर्ण प्रतिफल प्राप्त कर लिया है।\n" * 3,
        "Le dépôt de garantie n'est pas remboursable avant l'état des lieux. " * 4,
        "ऋण की अदायगी 284 किस्तों में की जाएगी। दोनों पक्ष 250 दिन की लिखित सूचना देकर अनुबंध समाप्त कर सकते हैं। " * 4,
    ],
)
def test_schedules_and_repeated_sentences_stay(text):
    assert spam.features(text)["stuffed"] <= spam.MORE_THAN
