"""Every query row against all rows, by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from paperlode.operators import retrieval
from paperlode.plans import catalog


def brute(rows, k, admitted):
    usable = {i: np.array(v, float) / np.linalg.norm(v) for i, v, _ in rows if v is not None and any(v)}
    among = {i for i, v, label in rows if i in usable and admitted(label)}
    out = {}
    for q in (i for i in usable if i % 50 == 0):
        s = sorted(((-round(float(usable[q] @ usable[i]), 12), i) for i in among))
        out[q] = [i for _, i in s[:k]]
    return out


@pytest.mark.parametrize("block", [2048, 60])
def test_knn_cosine_all(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], i % 10) for i in range(400)]
    rows[50] = (50, None, 0)
    rows[100] = (100, [0.0] * 8, 0)
    rows += [(400 + i, rows[150][1], i % 10) for i in range(15)]  # copies: ties by key
    rows += [rows[0]]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(x.vec_id, x.embedding, x.label) for x in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    for name, admitted in (("knn_cosine_all", lambda x: True), ("knn_cosine_labels", lambda x: x <= 4)):
        got: dict = {}
        for x in sorted(catalog.QUERIES[name](spark, str(tmp_path)).collect(), key=lambda x: (x.query_id, -x.similarity, x.vec_id)):
            got.setdefault(x.query_id, []).append(x.vec_id)
        assert got == brute(dict.fromkeys((i, tuple(v) if v else None, n) for i, v, n in rows), 10, admitted)
        assert {0, 150, 200} <= set(got) and not {50, 100} & set(got)
