"""Secret scans: long candidates, windows against counts afresh, findings that overlap."""

from __future__ import annotations

import collections
import math
import random
import time

import pytest

from tempora.llm import secrets


def windows(value, c):
    """(first, end) of the windows over the threshold, every one counted afresh."""
    most = math.floor(c.window * (math.log2(c.window) - c.bits) * secrets.UNIT)
    hot = [
        i for i in range(len(value) - c.window + 1)
        if sum(round(n * math.log2(n) * secrets.UNIT) for n in collections.Counter(value[i : i + c.window]).values()) <= most
    ]
    return (hot[0], hot[-1] + c.window) if hot else None


@pytest.mark.parametrize("which", [0, 1])
def test_windows_by_brute_force(spark, which):
    rng, c = random.Random(which), secrets.CLASSES[which]
    letters = c.alphabet
    rows = []
    for i in range(120):
        few = rng.sample(letters, rng.randint(6, len(letters)))
        rows.append((i, "a1" + ("B" if which else "") + "".join(rng.choice(few) for _ in range(rng.randint(c.window, 90)))))
    got = {r.doc_id: r.spans for r in secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), classes=(c,), allow="^$"), (c,)).collect()}
    found = 0
    for i, v in rows:
        mine = [x for x in got[i].split(",") if x.startswith("entropy")]
        w = windows(v, c)
        if w is None:
            assert not mine
        elif mine:
            assert mine == [f"{c.kind}:{w[0]}:{w[1]}"]
            found += 1
    assert found > 20


def test_long_candidate_in_linear_time(spark):
    rng = random.Random(3)
    text = "x " + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.report(secrets.scan(df.selectExpr("doc_id", "substring(text, 1, 2000) AS text"))).collect()
    t = time.perf_counter()
    got = secrets.report(secrets.scan(df)).collect()[0].spans
    assert got == f"entropy_base64:2:{len(text)}" and time.perf_counter() - t < 20


def test_base_findings_within_an_added_one(spark):
    rng = random.Random(5)
    tail = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))
    run = "0123456789abcdef"[::-1] * 2 + "Q" + tail
    df = spark.createDataFrame([(1, f"see {run} here"), (2, f"token = '{tail}'")], "doc_id long, text string")
    got = secrets.report(secrets.scan(df)).orderBy("doc_id").collect()
    assert got[0].n_hex == 1 and f"entropy_base64:4:{4 + len(run)}" in got[0].spans and "entropy" not in got[1].spans
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()] == ["see [SECRET] here", "[SECRET]'"]
