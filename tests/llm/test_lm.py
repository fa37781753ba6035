"""The suffix tree by plain counting, and what it gains on texts that it hasn't seen."""

from __future__ import annotations

import collections
import math
import random
import zlib

from tempora.llm import lm


def brute(train, texts):
    """log10 probabilities of texts by a suffix tree that is grown and walked with dictionaries."""

    def symbols(t):
        words = t.encode().lower().split()
        return [None] * lm.DEPTH + [b for w in words for b in (*w, " ")] + [None]

    c = collections.defaultdict(collections.Counter)
    for t in train:
        s = symbols(t)
        for i in range(lm.DEPTH, len(s)):
            for k in range(lm.DEPTH + 1):
                c[tuple(s[i - k : i])][s[i]] += 1
    c = {x: n for x, n in c.items() if not x or sum(n.values()) >= lm.SUPPORT}
    root_total = sum(c.get((), {}).values())

    def p(context, a):
        if not context:
            return (c.get((), {}).get(a, 0) + 1) / (root_total + lm.SIZE)
        if context not in c:
            return p(context[1:], a)
        n = c[context]
        return (n[a] + lm.PRIOR * p(context[1:], a)) / (sum(n.values()) + lm.PRIOR)

    keep = set()
    for x, n in c.items():
        total = sum(n.values())
        if x and sum(m * math.log(m / total / p(x[1:], a)) for a, m in n.items()) > 0.5 * len(n) * math.log(total + 1):
            keep |= {x[i:] for i in range(len(x))}
    out = []
    for t in texts:
        s, total = symbols(t), 0.0
        for i in range(lm.DEPTH, len(s)):
            x = tuple(s[i - lm.DEPTH : i])
            while x and x not in keep:
                x = x[1:]
            total += math.log10(p(x, s[i]))
        out.append(total)
    return out, len(keep)


def test_scores_by_plain_counting(spark):
    rng = random.Random(2)
    words = ["the", "cat", "sat", "on", "a", "mat", "été", "猫がいる", "x" * 300, "Zürich", "\U0001f600\U0001f600"]
    texts = {i: " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 60))) for i in range(120)} | {200: "", 201: "qqq new", 202: "猫 of " * 40, 203: "\x1c\x85 \t a\n"}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    want, kept = brute(train, texts.values())
    got = {r.doc_id: r for r in lm.evaluate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert kept > 50
    for (i, _), w in zip(texts.items(), want, strict=True):
        assert abs(got[i].score - w) < 1e-6 + 1e-9 * abs(w)


def test_gain_on_texts_held_out(spark):
    """Against bytes without context."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    spelled = {i: b"".join(w + b" " for w in t.encode().lower().split()) + b"\n" for i, t in texts.items()}
    rows = [r for r in lm.query(spark, sf).collect() if r.held_out]
    c = collections.Counter(b for i, t in spelled.items() if zlib.crc32(str(i).encode()) % 7 != 2 for b in t)
    n = sum(c.values())
    plain = sum(math.log10((c[b] + 1) / (n + 256)) for r in rows for b in spelled[r.doc_id])
    assert len(rows) > 10 and sum(r.score for r in rows) > 0.75 * plain


def test_a_frequent_long_word_is_no_key_of_a_join(spark):
    """A ruler of 80 dashes is in the head, by its digest."""
    ruler = "-" * 80
    rows = [(i, f"{ruler} a{i} {ruler}") for i in range(40)]
    got = {r.doc_id: r for r in lm.evaluate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        assert abs(got[i].base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t.split(), None])) < 1e-9
        assert got[i].n_known == sum(c[w] > 0 for w in [*t.split(), None])
