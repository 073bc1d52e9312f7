"""Recall with two and three hashes a table, and the exact way for vectors without near neighbours."""

from __future__ import annotations

import numpy as np
import pytest

from paperlode.llm import vectors


def table(spark, x):
    return spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>")


def recall(df, x, queries, **options):
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found: dict[int, set] = {}
    for r in vectors.nearest(df, **options).collect():
        found.setdefault(r.vec_id, set()).add(r.hit_vec_id)
    hits = []
    for q in queries:
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        hits.append(len(found.get(q, set()) & set(np.lexsort((np.arange(len(x)), -s))[:5].tolist())) / 5)
    return sum(hits) / len(hits)


@pytest.mark.parametrize(("bucket", "hashes"), [(2, 2), (0.05, 3)])
def test_recall_with_more_hashes(spark, monkeypatch, bucket, hashes):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(100, 64)), 10, 0) + 0.3 * r.normal(size=(1000, 64))
    monkeypatch.setattr(vectors, "BUCKET", bucket)
    assert vectors.tables_for(hashes) == vectors.TABLES * 2 ** (hashes - 1)
    assert recall(table(spark, x), x, range(0, 1000, 13)) >= 0.9


def test_exact_on_vectors_without_near_neighbours(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(700, 16))
    monkeypatch.setattr(vectors, "BLOCK", 100)  # a grid of blocks
    assert recall(table(spark, x), x, range(0, 700, 7), exact=True) == 1
