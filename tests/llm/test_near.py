"""Near-dedup: what must never be linked, what must always be, rows without ids of their own."""

from __future__ import annotations

import random

import numpy as np

from tempora.llm import common as C
from tempora.llm import near


def test_words_that_collide_under_polynomials(spark):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2^64 for any odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word.upper()), (4, word[:256]), (5, other[:256]), (6, word[:64]), (7, other[:64])]
    got = {r.doc_id: r.component_id for r in near.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}


def test_word_hashes_tell_words_apart():
    rng = random.Random(4)
    words = list({"".join(rng.choice("ab\x01") for _ in range(rng.randint(1, 40))) for _ in range(20000)} | {"a" * n for n in range(1, 600)})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e, _ = C.words(np.array([0, len(data)]), data)
    h = C.word_hashes(data, s, e)
    assert len(set(h.tolist())) == len(words)
    again = np.frombuffer(("xyz " + " ".join(words)).encode(), np.uint8)
    s, e, _ = C.words(np.array([0, len(again)]), again)
    assert (C.word_hashes(again, s, e)[1:] == h).all()


def test_pairs_at_the_threshold(spark):
    """Pairs of similarity 0.800 to 0.805, each linked in no other way."""
    rng, rows = random.Random(9), []
    for i in range(2500):
        w = [f"{rng.randrange(10**9)}" for _ in range(92)]
        # 89 or 90 shingles of four words in common of 111 or 112 at most
        cut = rng.choice([10, 10, 10, 9])
        rows += [(2 * i, " ".join(w[: 92 - cut])), (2 * i + 1, " ".join(w[cut:]))]
    got = {r.doc_id: r.component_id for r in near.link(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    shares = [(92 - 2 * c - 3) / (92 - 3) for c in (10, 9)]
    want = {}
    for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True):
        one, two = ({tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in (x, y))
        linked = 100 * len(one & two) >= 80 * len(one | two)
        want |= {a: a, b: a if linked else b}
    assert got == want and 0.75 < shares[0] < shares[1]


def test_rows_without_ids_of_their_own(spark):
    base = [f"w{i}" for i in range(60)]
    text, similar, other = " ".join(base), " ".join([*base[:58], "x", "y"]), " ".join(reversed(base))
    rows = [(5, text, 1), (5, text, 2), (5, other, 3), (None, text, 4), (None, similar, 5), (7, similar, 6), (None, None, 7), (None, "", 8), (9, other, 9), (None, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    kept = near.dedup(df).collect()
    assert df.columns == near.dedup(df).columns
    texts = [r.text for r in kept]
    assert sorted(t for t in texts if t) == sorted([text, other]) and texts.count(None) == 2 and texts.count("") == 1
    assert {r.doc_id for r in kept if r.text} == {5}
    links = near.link(df).collect()
    assert len(links) == 10 and sum(r.kept for r in links) == 5 and {r.component_id for r in links if r.n_shingles} == {5}
    assert near.dedup(df.limit(0)).count() == 0
