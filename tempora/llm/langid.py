"""Language identification by a blended-spectrum string kernel.

A text is the set of its byte 1- to 3-grams (ASCII letters in lower case); the
kernel of two texts is the cosine of their presence vectors, over all grams.
Landmarks from the sample give Nyström features, on which one ridge regression per
language is fitted against the rest. All texts are scored by two matrix products a
batch: grams that no landmark has only count in a text's norm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Documents that the model is fitted on at most, in equal parts of each language (LEAST at least): those of smallest hash of doc_id.
SAMPLE, LEAST, MERGES = 2000, 8, 8
LANDMARKS, RIDGE, SHARPNESS = 160, 1e-2, 6.0
FOLDS, HELD_OUT, ROWS = 3, 1, 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # codes of all grams of the landmarks
    landmarks: np.ndarray  # presence, float32
    weights: np.ndarray


def codes(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, document number) of the 1-, 2- and 3-grams of a run, none across documents."""
    d = C.LOWER[data].astype(np.int32)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    yield d, doc
    for n in (1, 2):
        d = d[:-1] << 8 | C.LOWER[data[n:]]
        same = doc[:-n] == doc[n:]
        yield d[same], doc[:-n][same]


def lookup(grams: np.ndarray) -> np.ndarray:
    table = np.full(1 << 24, len(grams), np.uint16 if len(grams) < 1 << 16 else np.uint32)
    table[grams] = np.arange(len(grams))
    return table


def presence(off: np.ndarray, data: np.ndarray, table: np.ndarray, n_grams: int) -> tuple[np.ndarray, np.ndarray]:
    """(presence of the known grams in each text, number of each text's distinct grams, the others included)."""
    n = len(off) - 1
    out = np.zeros((n, n_grams + 1), bool)
    other = []
    for code, doc in codes(off, data):
        at = table[code]
        out[doc, at] = True
        new = at == n_grams
        other.append(np.unique(doc[new].astype(np.int64) << 24 | code[new]) >> 24)
    known = out[:, :n_grams].astype(np.float32)
    return known, known.sum(1) + np.bincount(np.concatenate(other), minlength=n)


def kernel(x: np.ndarray, size: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Cosines; a landmark has no grams but the known ones."""
    return (x @ landmarks.T) / np.maximum(np.sqrt(np.outer(size, landmarks.sum(1))), 1)


def fit(texts: pa.Array, langs: list[str]) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    y = np.array([names.index(v) for v in langs])
    turn = np.zeros(len(y), int)  # landmarks by turns of the languages, however rare one is
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = texts.take(pa.array(np.sort(np.lexsort((y, turn))[: max(LANDMARKS, len(names))])))
    grams = np.unique(np.concatenate([np.unique(code) for _, _, off, data in C.runs(chosen) for code, _ in codes(off, data)]))
    table = lookup(grams)
    marks = np.vstack([presence(off, data, table, len(grams))[0] for _, _, off, data in C.runs(chosen, rows=ROWS)])
    values, vectors = np.linalg.eigh(kernel(marks, marks.sum(1), marks) + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-8))
    phi = np.vstack([kernel(*presence(off, data, table, len(grams)), marks) for _, _, off, data in C.runs(texts, rows=ROWS)]) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    ridge = np.linalg.solve(phi.T @ phi + RIDGE * len(y) / 100 * np.eye(phi.shape[1]), phi.T @ target)
    return Model(names, grams, marks, root @ ridge)


def _smallest(share: int):
    """Of each language the rows (id, lang, hash) of smallest hash that a task has, share at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            order = pc.sort_indices(t, sort_keys=[("lang", "ascending"), ("hash", "ascending"), ("id", "ascending")])
            t = t.take(order).combine_chunks()
            lang = t.column("lang").dictionary_encode().combine_chunks().indices.to_numpy() if t.num_rows else np.zeros(0, int)
            first = np.flatnonzero(np.r_[True, lang[1:] != lang[:-1]]) if len(lang) else np.zeros(0, int)
            rank = np.arange(len(lang)) - np.repeat(first, np.diff(np.r_[first, len(lang)]))
            held = t.filter(pa.array(rank < share))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    labelled = docs.select(docs[id_col].cast("long").alias("id"), docs[lang_col].alias("lang"), docs[text_col].isNotNull().alias("told")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("told") & (C.remainder("id", FOLDS) != HELD_OUT)
    )
    n = labelled.select("lang").distinct().count()
    share = max(LEAST, sample // max(1, n))
    # each task's smallest, then those of MERGES tasks, so a language's rank is told from share * MERGES rows at most
    kind = "id long, lang string, hash long"
    few = labelled.select("id", "lang", F.xxhash64("id").alias("hash")).mapInArrow(_smallest(share), kind)
    fewer = few.groupBy("id").agg(F.min("lang").alias("lang"), F.min("hash").alias("hash")).coalesce(MERGES).mapInArrow(_smallest(share), kind)
    ranked = fewer.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id")))
    ids = ranked.where(F.col("rank") <= share).select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), F.col("rank").alias("_order")).orderBy("_order", "_lang").limit(max(sample, LEAST * n))
    got = C.sample_texts(docs, ids, id_col, text_col)
    got = got.take(pc.sort_indices(got, sort_keys=[("_id", "ascending")]))
    model = fit(got.column("_text").combine_chunks(), got.column("_lang").to_pylist())
    del got
    C.trim()
    return model


def predict(model: Model, table: np.ndarray, off: np.ndarray, data: np.ndarray) -> tuple[list[str], np.ndarray]:
    """A text without any letter is und with score 0; ties go to the language that sorts first."""
    n = len(off) - 1
    letters = np.zeros(n, bool)
    letters[np.searchsorted(off, np.flatnonzero(_LETTER[data]), "right") - 1] = True
    for i in np.flatnonzero(~letters):
        letters[i] = any(map(str.isalpha, bytes(data[off[i] : off[i + 1]]).decode(errors="replace")))
    if not model.langs:
        return ["und"] * n, np.zeros(n)
    z = SHARPNESS * (kernel(*presence(off, data, table, len(model.grams)), model.landmarks) @ model.weights)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [model.langs[b] if a else "und" for a, b in zip(letters, best, strict=True)], np.where(letters, p[np.arange(n), best], 0.0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; null and empty texts are und, null ids and repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lookup(shared.value.grams)
        for b in batches:
            for lo, hi, off, data in C.runs(b.column(1), rows=ROWS):
                lang, p = predict(shared.value, table, off, data)
                yield C.batch({"doc_id": b.column(0).slice(lo, hi - lo), "lang_pred": pa.array(lang, pa.string()), "score": p.astype(float)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", (C.remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
