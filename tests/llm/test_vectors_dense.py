"""A group of vectors that are linked or not, well beyond one block; what crosses balls isn't paired."""

from __future__ import annotations

import numpy as np
import pytest

from tempora.llm import vectors


@pytest.mark.parametrize("block", [vectors.BLOCK, 24])
def test_dense_group(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=48)
    x = np.array([centre + rng.normal(size=48) * rng.uniform(0.2, 0.45) for _ in range(300)] + [rng.normal(size=48) for _ in range(60)])
    x[10] = x[11]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    got = {r.vec_id: r for r in vectors.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)).collect()}
    have = np.array([got[i].n_links for i in range(len(x))])
    assert 0.2 < s[:300, :300].mean() < 0.95
    assert (have <= s.sum(1)).all() and have.sum() >= 0.99 * s.sum()
    reach = s | np.eye(len(x), dtype=bool)
    for _ in range(9):
        reach = reach @ reach
    assert [got[i].component_id for i in range(len(x))] == reach.argmax(1).tolist()
