"""Components of random graphs and chains against union-find."""

from __future__ import annotations

import random

from tempora.llm import components as K


def brute(edges):
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components(spark, monkeypatch):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1090)]
    edges = chain + [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(-5, 3), (7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = brute([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in K.components(df).collect()} == want
    monkeypatch.setattr(K, "ROWS", 10)
    assert {r.node: r.component for r in K.components(df).collect()} == want
    assert K.components(df.limit(0)).count() == 0
