from __future__ import annotations

import numpy as np
import pytest

from paperlode.llm import vectors


def brute(rows, k=5):
    keep = [(i, np.array(e, np.float32).astype(float)) for i, e in rows if i is not None and e is not None and None not in e and any(e)]
    keep.sort(key=lambda x: x[0])
    ids = [i for i, _ in keep]
    u = np.array([e / np.sqrt((e * e).sum()) for _, e in keep])
    sims = np.round(u @ u.T, 12)
    np.fill_diagonal(sims, -9)
    return {ids[a]: [ids[b] for b in np.argsort(-sims[a], kind="stable")[:k] if b != a] for a in range(len(ids))}


def clustered(n, dim=64, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 20 + 1, dim))
    return [(int(i) * 3 + 1, (centres[i % len(centres)] + 0.12 * r.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id bigint, embedding array<float>, rid string")


def test_recall_and_ties(spark):
    rows = clustered(1500)
    rows += [(9000 + i, rows[0][1]) for i in range(12)] + [(9100, [4 * x for x in rows[5][1]]), (9101, None), (9102, [0.0] * 64), (9103, [1.0, None] + [0.0] * 62), (None, rows[1][1]), rows[7]]
    want = brute([r for n, r in enumerate(rows) if r not in rows[:n] or r[0] is None])
    got: dict = {}
    for r in vectors.nearest(frame(spark, rows)).orderBy("vec_id", "hit_rank").collect():
        got.setdefault(r.vec_id, []).append(r.hit_vec_id)
    assert set(got) == set(want)
    assert np.mean([len(set(got[i]) & set(w)) / len(w) for i, w in want.items()]) >= 0.97
    for i in (rows[0][0], 9000, 9011):  # copies: the smallest ids win
        assert got[i] == want[i]


def test_full_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = clustered(400, seed=4)
    got = {(r.vec_id, r.hit_vec_id) for r in vectors.nearest(frame(spark, rows)).collect()}
    want = {(i, j) for i, w in brute(rows).items() for j in w}
    assert len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, None)]])
def test_small(spark, rows):
    assert vectors.nearest(frame(spark, rows)).count() == 0


def test_pairs(spark):
    h = vectors.nearest(frame(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])]), k=1)
    assert {tuple(r) for r in vectors.pairs(h).collect()} <= {(1, 3), (1, 2)} and (1, 3) in {tuple(r) for r in vectors.pairs(h).collect()}


def test_rotations_keep_lengths():
    m = vectors.rotations(64, 1)[0]
    assert np.allclose(m @ m.T, np.eye(64), atol=1e-5)
