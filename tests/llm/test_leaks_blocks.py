"""Passages found by blocks against all windows, and the size of the automaton."""

from __future__ import annotations

import random

from paperlode.llm import leaks


def windows(items, words, n):
    """By brute force: every window of n words."""
    found = {}
    for item, text in items:
        own = leaks.normalised(text)[0]
        known = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        merged = []
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in known:
                if merged and i <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], i + n)
                else:
                    merged.append((i, i + n))
        if merged:
            found[item] = merged
    return found


def test_against_all_windows():
    r = random.Random(4)
    word = lambda: r.choice("ab cd ef gh ij kl".split())
    for n in (2, 3, 5, 13):
        for _ in range(60):
            items = [(k, " ".join(word() for _ in range(r.randint(1, 40)))) for k in range(4)]
            words = [word() for _ in range(60)]
            if r.random() < 0.8:
                own = leaks.normalised(items[0][1])[0]
                words[10 : 10 + len(own)] = own
            assert leaks.Blocks(items, n).runs(words) == windows(items, words, n)


def test_nodes_are_bounded_by_the_characters():
    r = random.Random(5)
    items = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(200))) for i in range(100)]
    size = sum(len(t) for _, t in items)
    stats = leaks.Blocks(items, 13).automaton.get_stats()
    assert stats["nodes_count"] <= 1.2 * size and stats["total_size"] < 90 * size
