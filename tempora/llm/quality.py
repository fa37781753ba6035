"""Quality classifier: random-indexing word vectors, pooled per document, under a
two-layer network with temperature-calibrated probabilities.

Every word has a sparse random ternary index vector derived from its hash; a
word's vector is the sum of its neighbours' index vectors over the sample. Words
outside the sample's vocabulary share the vector of their shape (which kinds of
characters they hold). A document is pooled over windows of words: the mean, the
extremes over windows, how uniform windows are and how often a word repeats. The model is fitted on the
driver from a bounded sample of labelled rows (SAMPLE); scoring reads every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Labelled documents that the model is fitted on at most: those of smallest hash of doc_id.
SAMPLE = 5000
VOCABULARY, DIM, NONZERO, WINDOW, HIDDEN = 20_000, 48, 4, 32, 32
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

_KIND = np.zeros(256, np.uint16)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
for _i, _c in enumerate(b"!.,|:;"):
    _KIND[_c] = 16 << min(_i, 4)
_KIND[[c for c in range(33, 127) if not _KIND[c]]] = 512
SHAPES = 1 << 10


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    vectors: np.ndarray  # of words, then of shapes
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    prior: float | None = None  # the score of any text where there was nothing to learn from


def tokens(off: np.ndarray, data: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the vector table, document number, 1 if it repeats the word before) of each word of a run."""
    s, e, d = C.words(off, data)
    if not len(s):
        return s, d, s
    h = C.word_hashes(data, s, e)
    edges = np.empty(2 * len(s), np.int64)
    edges[::2], edges[1::2] = s, np.minimum(e, len(data) - 1)
    kinds = np.bitwise_or.reduceat(_KIND[data], edges)[::2]
    if e[-1] == len(data):
        kinds[-1] = np.bitwise_or.reduce(_KIND[data[s[-1] :]])
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    hit = known[at] == h if len(known) else np.zeros(len(h), bool)
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return np.where(hit, at, len(known) + kinds), d, again


def pooled(tok: np.ndarray, doc: np.ndarray, again: np.ndarray, n: int, vectors: np.ndarray) -> np.ndarray:
    """One row of features for each of n documents; zeros for one without words."""
    dim = vectors.shape[1]
    out = np.zeros((n, 3 * dim + 6), np.float32)
    if not len(tok):
        return out
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    place = np.arange(len(tok)) - np.repeat(first, np.diff(np.r_[first, len(tok)]))
    cuts = np.flatnonzero(place % WINDOW == 0)
    sizes = np.diff(np.r_[cuts, len(tok)])
    sums = np.add.reduceat(vectors[tok], cuts, axis=0)
    means = sums / sizes[:, None]
    norms = np.sqrt((means**2).sum(1))
    docs = doc[cuts]
    wfirst = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    count = np.add.reduceat(sizes, wfirst)
    rows = docs[wfirst]
    out[rows, :dim] = np.add.reduceat(sums, wfirst, axis=0) / count[:, None]
    out[rows, dim : 2 * dim] = np.maximum.reduceat(means, wfirst, axis=0)
    out[rows, 2 * dim : 3 * dim] = np.minimum.reduceat(means, wfirst, axis=0)
    out[rows, 3 * dim] = np.log1p(count)
    out[rows, 3 * dim + 1] = np.maximum.reduceat(norms, wfirst)
    out[rows, 3 * dim + 2] = np.add.reduceat(norms, wfirst) / np.diff(np.r_[wfirst, len(docs)])
    out[rows, 3 * dim + 3] = np.minimum.reduceat(norms, wfirst)
    repeats = np.add.reduceat(again, cuts) / sizes
    out[rows, 3 * dim + 4] = np.maximum.reduceat(repeats, wfirst)
    out[rows, 3 * dim + 5] = np.add.reduceat(repeats, wfirst) / np.diff(np.r_[wfirst, len(docs)])
    return out


def index_vectors(keys: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Sparse ternary vectors, a function of the key alone."""
    out = np.zeros((len(keys), dim), np.float32)
    rows = np.arange(len(keys))
    for k in range(NONZERO):
        h = C.mix(keys + np.uint64(0x9E37 * (k + 1)))
        out[rows, (h >> np.uint64(1)) % np.uint64(dim)] += np.where(h & np.uint64(1), 1, -1)
    return out


def random_indexing(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the words that get vectors, vectors of these and of the shapes)."""
    seen = [C.word_hashes(data, *C.words(off, data)[:2]) for _, _, off, data in C.runs(texts)]
    words, counts = np.unique(np.concatenate([*seen, np.zeros(0, np.uint64)]), return_counts=True)
    common = counts >= 3
    top = np.lexsort((words[common], -counts[common]))[:VOCABULARY]
    words = np.sort(words[common][top])
    index = index_vectors(np.r_[words, np.arange(SHAPES, dtype=np.uint64)])
    vectors = np.zeros_like(index)
    for _, _, off, data in C.runs(texts, 1 << 18):
        tok, doc, _ = tokens(off, data, words)
        for step in (1, 2):
            same = doc[step:] == doc[:-step]
            for a, b in ((tok[step:][same], tok[:-step][same]), (tok[:-step][same], tok[step:][same])):
                if len(a):
                    order = np.argsort(a, kind="stable")
                    first = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]])
                    vectors[a[order][first]] += np.add.reduceat(index[b[order]], first, axis=0)
    norms = np.sqrt((vectors**2).sum(1, keepdims=True))
    lone = norms[:, 0] == 0  # shapes that the sample hasn't are their own index vectors
    vectors[lone] = index[lone]
    return words, vectors / np.sqrt((vectors**2).sum(1, keepdims=True)).clip(1e-6)


def forward(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.maximum(x @ a + b, 0)
    return hidden, hidden @ c + d


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60) -> tuple[tuple[np.ndarray, ...], float]:
    """Adam on the logistic loss; then the temperature that fits every seventh row, kept apart, best."""
    rng = np.random.default_rng(7)
    apart = np.arange(len(y)) % 7 == 6
    xt, yt = x[~apart], y[~apart]
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(yt))
        for lo in range(0, len(order), 128):
            xb, yb = xt[order[lo : lo + 128]], yt[order[lo : lo + 128]]
            h, z = forward(xb, tuple(layers))
            g = (sigmoid(z) - yb) / len(yb)
            back = np.outer(g, layers[2]) * (h > 0)
            grads = [xb.T @ back + 1e-4 * layers[0], back.sum(0), h.T @ g + 1e-4 * layers[2], g.sum()]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr**2
                layers[i] = layers[i] - 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    if not apart.any():
        return tuple(layers), 1.0
    z, y = forward(x[apart], tuple(layers))[1], y[apart]
    grid = np.geomspace(0.25, 8, 60)
    loss = [-np.mean(np.log(np.where(y == 1, sigmoid(z / k), 1 - sigmoid(z / k)) + 1e-12)) for k in grid]
    return tuple(layers), float(grid[int(np.argmin(loss))])


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Without texts of both labels the score of every text is their share of 1, drawn to a half."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros((SHAPES, DIM), np.float32), np.zeros(1), np.ones(1), (), 1.0, float((labels.sum() + 1) / (len(labels) + 2)))
    words, vectors = random_indexing(texts)
    x = np.vstack([pooled(*tokens(off, data, words), len(off) - 1, vectors) for _, _, off, data in C.runs(texts)])
    centre, scale = x.mean(0), x.std(0) + 1e-3
    layers, temperature = train((x - centre) / scale, labels.astype(float))
    return Model(words, vectors.astype(np.float32), centre, scale, layers, temperature)


def predict(model: Model, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    if model.prior is not None:
        return np.full(n, model.prior)
    x = (pooled(*tokens(off, data, model.words), n, model.vectors) - model.centre) / model.scale
    return sigmoid(forward(np.clip(x, -20, 20), model.layers)[1] / model.temperature)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled documents outside the held-out fold. Of several labels of a document the smallest counts."""
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("double").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (C.remainder("_id", FOLDS) != HELD_OUT))
        .groupBy("_id").agg(F.min("_label").alias("_label")).withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(sample)
    )
    got = C.sample_texts(docs, ids, id_col, text_col)
    order = pc.sort_indices(got, sort_keys=[("_id", "ascending")])
    got = got.take(order)
    model = fit(got.column("_text").combine_chunks(), np.array(got.column("_label").to_pylist(), float))
    del got
    C.trim()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row. Null and empty texts get the score of no words; rows, also with null ids, stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, off, data in C.runs(b.column(1), rows=4096):
                yield C.batch({"doc_id": b.column(0).slice(lo, hi - lo), "score": predict(shared.value, off, data).astype(float)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that the model doesn't reject. Null and empty texts are judged as texts of no words,
    repeated rows and null ids each for themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    good = C.flags(lambda off, data: predict(shared.value, off, data) >= threshold)
    return docs.where(good(docs[text_col]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, learn(docs, labels)).select(
        "doc_id", (C.remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
