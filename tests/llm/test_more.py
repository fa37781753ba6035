"""Long texts, rare languages, short and many benchmark items, stages over empty tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tempora.llm import bpe, chats, decontaminate, langid, lm, near, quality, secrets, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long(spark):
    """A text of two megabytes, twice, among short ones."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    text = " ".join(rng.choice(words) for _ in range(330_000))
    return spark.createDataFrame([(1, text, "en", "a", len(text)), (2, text, "en", "a", len(text)), (3, "short one", "en", "b", 9), (4, None, None, None, None)], SCHEMA)


def test_long_texts(spark, long):
    assert [(r.component_id, r.kept) for r in near.link(long).orderBy("doc_id").collect()] == [(1, True), (1, False), (3, True), (4, True)]
    got = substrings.remove(long).orderBy("doc_id").collect()
    assert [r.n_removed == r.n_bytes and r.n_spans == 1 for r in got[:2]] == [True, True] and got[2].n_removed == 0
    assert secrets.scan(long).count() == 4 and lm.evaluate(long).count() == 4
    assert all(r.decoded_ok for r in bpe.encode_documents(long, *bpe.default_vocabulary()).collect())
    model = langid.learn(long)
    assert {r.doc_id: r.lang_pred for r in langid.identify(long, model).collect()}[4] == "und"
    bench = spark.createDataFrame([(9, "not there at all, whatever is said")], "item_id long, text string")
    assert decontaminate.leaks(long, bench).count() == 0


def test_a_rare_language_is_learned(spark):
    rng = random.Random(2)
    letters = {"aa": "abcde", "bb": "klmno"}
    make = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(12))
    rows = [(i, make("aa"), "aa", None, None) for i in range(3000)] + [(3000 + i, make("bb"), "bb", None, None) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(df, sample=100)
    assert model.langs == ["aa", "bb"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert all(got[i] == lang for i, _, lang, *_ in rows)


def test_kernel_by_sets():
    """Cosines of the sets of all 1- to 3-grams, those that no landmark has included."""
    texts = ["abc abd", "abc zzq", "", "x", "Abc ABD", "qqqq rrrr"]
    model = langid.fit(pa.array(texts[:2] * 3), ["u", "v"] * 3)
    raw = [t.lower().encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    k = langid.kernel(*langid.presence(off, data, langid.lookup(model.grams), len(model.grams)), model.landmarks)
    grams = lambda r: {r[i : i + n] for n in (1, 2, 3) for i in range(len(r) - n + 1)}
    marks = [grams(r) for r in (raw[:2] * 3)]
    for i, r in enumerate(raw):
        for j, m in enumerate(marks):
            assert abs(k[i, j] - len(grams(r) & m) / max(1, (len(grams(r)) * len(m)) ** 0.5)) < 1e-6


def test_short_items_and_many_blocks(spark, monkeypatch):
    items = [(1, "abc"), (2, " Abc\n"), (3, "a passage that is long enough"), (4, "12345678"), (5, None), (6, ""), (7, "another passage, of some length")]
    docs = [(1, "abc", 0), (2, "\tABC ", 0), (3, "xabc", 0), (4, "say a passage that is long enough here", 0), (5, "12345678", 0), (6, "", 0), (7, None, 0), (8, "another passage, of som length", 0)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    want = [(1, 1), (1, 2), (2, 1), (2, 2), (4, 3), (5, 4), (8, 7)]
    for size in (decontaminate.BLOCK, 20):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        found = decontaminate.leaks(df, bench).collect()
        assert sorted((r.doc_id, r.item_id) for r in found) == want
        assert {(r.start, r.end) for r in found if r.doc_id == 2} == {(1, 4)}
        kept = decontaminate.clean(df, bench)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 6, 7]


def test_stages_over_nothing_and_null_ids(spark):
    sf = "/root/testdata/sf0.001"
    none = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(None, "some text of words " * 9, "en", None, None), (None, None, None, None, None), (3, "", None, "s", 0), (3, "x", None, None, 1)], SCHEMA)
    for docs, least in ((none, 0), (odd, 1)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert out.count() >= least
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns


def test_held_out_quality(spark):
    """Ranking and calibration, not accuracy alone, which the share of good texts gives away."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in quality.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) > 5 and auc > 0.98 and np.mean([(s - y) ** 2 for s, y in rows]) < 0.03
    assert abs(np.mean([s for s, _ in rows]) - np.mean([y for _, y in rows])) < 0.05


def test_where_collapsed_chats_went(spark):
    rows = [(1, 0, "u", "hi"), (2, 0, "u", "hi"), (2, 1, "a", "yo"), (3, 0, "u", "hi"), (3, 1, "a", "yo"), (4, 0, "u", "bye"), (6, 0, "u", "hi"), (6, 1, "a", "no"), (None, 0, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.kept_id for r in chats.membership(chats.rolling(df)).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4, 6: 6}
    assert chats.membership(chats.rolling(df.limit(0))).count() == 0


def test_chats_of_many_turns_and_clashing_columns(spark):
    rows = [(1, i, "u" if i % 2 == 0 else "a", f"t{i}", 5) for i in range(3000)] + [(2, i, "u" if i % 2 == 0 else "a", f"t{i}", 6) for i in range(2990)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").repartition(5)
    got = chats.format_chats(df).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 3000)]
