"""The logarithmic family, and the comparison of segments in batches."""

from __future__ import annotations

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest

from tempora.llm import substrings


def test_levels_grow_geometrically():
    f, seen = substrings.Family(), collections.Counter()
    rng = np.random.default_rng(3)
    for k in range(40):
        x = np.array([f"{v:05d}" for v in rng.integers(0, 3000, 50)], "S5")
        again = set(np.concatenate(f.add(x, np.arange(50) + 50 * k)).tolist())
        before = set(seen)
        seen.update(x.tolist())
        assert {50 * k + i for i, v in enumerate(x.tolist()) if v in before or (x == v).sum() > 1} <= again
        sizes = [len(a) for a, _ in f.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(f) == len(seen)
    assert f.merges > 10


def test_forgetting_keeps_what_stays():
    f = substrings.Family()
    for k in range(8):
        f.add(np.arange(10, dtype=np.uint64) * 8 + k, np.arange(10) + 10 * k)
    stays = np.arange(80) % 3 == 0
    f.forget(stays)
    assert len(f) == stays.sum()
    again = np.concatenate(f.add(np.arange(80, dtype=np.uint64), 100 + np.arange(80)))
    assert sorted(x for x in again.tolist() if x < 100) == list(range(int(stays.sum())))


@pytest.fixture(scope="module")
def real():
    rows = duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    return list(dict.fromkeys(t.encode() for (t,) in rows))


def scanned(texts, limit, batch):
    """Spans of repeated strings by a scan of all segments, sorted by anchor, without Spark."""
    rows = []
    for i, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        _, place, core, _ = substrings.anchors(np.array([0, len(t)]), data)
        for p, c in zip(place.tolist(), core.view(np.int64).tolist(), strict=True):
            a = max(0, p - substrings.REACH)
            rows.append((c, t[a : p + substrings.LENGTH], p - a, a, i))
    rows.sort(key=lambda r: r[0])
    scan, out = substrings.Scan(limit), collections.defaultdict(set)
    for lo in range(0, len(rows), batch):
        c, text, place, start, number = map(list, zip(*rows[lo : lo + batch], strict=True))
        for b in scan.feed(np.array(c), text, np.array(place), np.zeros(len(c), bool), np.array(start), np.array(number), np.ones(len(c), bool)):
            for n, s, e in zip(*(x.to_pylist() for x in b.columns), strict=True):
                out[n] |= set(range(s, e))
    return scan, out


@pytest.mark.parametrize("limit", [substrings.HELD, 2000])
def test_batches_of_ordinary_documents_merge_levels(real, limit, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", limit)
    texts = real[:150]
    scan, out = scanned(texts, limit, 200)
    assert limit == 2000 or (scan.parts.merges > 3 and scan.suffixes.merges > 1)
    where = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for a in range(len(t) - 399):
            where[hashlib.blake2b(t[a : a + 400], digest_size=12).digest()].append((i, a))
    want = collections.defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for i, a in places:
                want[i] |= set(range(a, a + 400))
    assert want and out == want


def test_strings_that_collide_under_polynomials(spark):
    """Texts of one length made of the Thue-Morse word and its complement: every byte stays."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    rng = random.Random(1)
    head = "".join(rng.choice("cdefgh") for _ in range(150))
    rows = [(1, head + word[:2048]), (2, head + word[2048:].translate(str.maketrans("ab", "ba"))[:1024] + word[1024:2048].translate(str.maketrans("ab", "ba"))), (3, head + word[:1024].translate(str.maketrans("ab", "ba")))]
    got = {r.doc_id: r.n_removed for r in substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    count = collections.Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    for i, t in rows:
        gone = {j for a in range(len(t) - 399) if count[t[a : a + 400]] > 1 for j in range(a, a + 400)}
        assert got[i] == len(gone)


def test_a_crowded_anchor(spark, monkeypatch):
    """One passage within many different documents: its anchors have more segments than one task should get."""
    monkeypatch.setattr(substrings, "HOT", 16)
    monkeypatch.setattr(substrings, "SHARES", 8)
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p = make(520)
    texts = [make(rng.randint(0, 300)) + p + make(rng.randint(0, 300)) for _ in range(120)] + [make(900) for _ in range(20)]
    got = [r.n_removed for r in substrings.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    count = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    assert got == [len({j for a in range(len(t) - 399) if count[t[a : a + 400]] > 1 for j in range(a, a + 400)}) for t in texts]
    assert min(got[:120]) >= 520
