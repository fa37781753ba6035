"""LM scoring by a probabilistic suffix tree over the bytes of words, beside an add-one word model.

A text is its words, each followed by a separator, then one end; words are
spelled in their bytes. Contexts of up to DEPTH symbols (padded with ends at a text's beginning)
are counted over all training texts. A context that was seen SUPPORT times at least
is retained if its next-symbol distribution diverges from its suffix's by more than
the description length of another distribution; so the tree grows with the corpus.
Distributions are smoothed towards the suffix's. The tree is kept in tables, one for
each length. A symbol is scored behind its longest retained suffix.

The scores of the HEAD_CODES most frequent codes (a symbol behind its context) are
broadcast; those of the others are joined by code. In the same way the HEAD most
frequent words are broadcast and the others joined by word, so no frequent word is a
key of a join; words over WHOLE_BYTES are known by a digest there.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FOLDS, HELD_OUT = 7, 2
DEPTH, SUPPORT, PRIOR = 5, 4, 8.0
HEAD, WHOLE_BYTES, FLUSH = 1 << 17, 64, 300_000
#: Tables of contexts up to the length SHORT are small and met by many codes.
HEAD_CODES, SHORT = 1 << 19, 2
#: Symbols are bytes; white space doesn't occur in words, so two of its bytes are free for separator and end.
SEP, END, BITS = 0x20, 0x0A, 8
SIZE, CHUNK = 1 << BITS, 256
_SYMBOLS = C.LOWER.copy()
_SYMBOLS[C.SPACE] = SEP


def training(id_col: str) -> Column:
    return C.remainder(id_col, FOLDS) != HELD_OUT


def _words(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only, which is what is asked for."""
    return text.encode().lower().split() if text else []


def _key(w: bytes) -> bytes:
    return w if len(w) <= WHOLE_BYTES else hashlib.md5(w, usedforsecurity=False).digest()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary; its key), c over a table with one column of texts, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = C.batch({"word": pa.array(list(held), pa.binary()), "c": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return b

        for b in batches:
            for text in b.column(0):
                held.update(map(_key, _words(text.as_py())))
                if len(held) > FLUSH:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def stream(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each behind DEPTH ends; offsets of the texts)."""
    space = C.SPACE[data]
    low = _SYMBOLS[data]
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    begins = off[:-1][off[:-1] < len(data)]
    before[begins] = True
    keep = ~(space & before)
    kept = np.r_[0, np.cumsum(keep)][off]
    low = low[keep]
    ends = kept[1:]
    filled = np.diff(kept) > 0
    open_ = filled & (low[np.maximum(ends - 1, 0)] != SEP) if len(low) else filled
    pads = np.repeat(kept[:-1], DEPTH)
    at = np.concatenate([pads, ends[open_], ends])
    what = np.concatenate([np.full(len(pads), END), np.full(int(open_.sum()), SEP), np.full(len(ends), END)])
    # a text's end comes before the next one's pads, which have the same place
    n = len(ends)
    text = np.concatenate([np.repeat(np.arange(n), DEPTH), np.flatnonzero(open_), np.arange(n)])
    kind = np.concatenate([np.zeros(len(pads)), np.ones(int(open_.sum())), np.full(n, 2)])
    order = np.lexsort((kind, text))
    out = np.insert(low, at[order], what[order].astype(np.uint8))
    return out, np.r_[0, np.cumsum(np.diff(kept) + DEPTH + 1 + open_)]


def codes(syms: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each predicted symbol behind its DEPTH symbols of context, as one number."""
    n = len(syms) - DEPTH
    out = np.zeros(n, np.int64)
    for j in range(DEPTH + 1):
        out = out << BITS | syms[j : j + n]
    inside = np.ones(n, bool)  # windows that begin in the last DEPTH symbols of a text run into the next one
    for j in range(1, DEPTH + 1):
        at = offs[1:-1] - j
        inside[at[(at >= 0) & (at < n)]] = False
    return out[inside]


def code_counts(texts: DataFrame) -> DataFrame:
    """code, n of all codes of the texts."""

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
        return (code[first], np.add.reduceat(n, first)) if len(code) else (code, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for b in batches:
            for _, _, off, data in C.runs(b.column(0), 4 << 20):
                parts.append(np.unique(codes(*stream(off, data)), return_counts=True))
                held += len(parts[-1][0])
                if held > 4_000_000:
                    parts = [merge(parts)]
                    held = len(parts[0][0])
                    if held > 3_000_000:
                        yield C.batch({"code": parts[0][0], "n": parts[0][1]})
                        parts, held = parts[:0] + [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        code, n = merge(parts)
        yield C.batch({"code": code, "n": n.astype(np.int64)})

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    root: list[float]  # probability of each symbol without context
    levels: list[DataFrame]  # context, total, p (next symbol -> smoothed probability, if seen), retained; for lengths 1 to DEPTH


def learn(deepest: DataFrame) -> Model:
    """The contexts seen SUPPORT times at least, as tables, and which of them are retained; from the result of code_counts()."""
    codes = [deepest]
    for k in range(DEPTH - 1, -1, -1):
        codes.insert(0, C.store(codes[0].groupBy(F.expr(f"code & {(1 << BITS * (k + 1)) - 1}L").alias("code")).agg(F.sum("n").alias("n"))))
    base = np.ones(SIZE)
    for code, n in codes[0].toLocalIterator():
        base[code] += n
    root = (base / base.sum()).tolist()
    up = deepest.sparkSession.createDataFrame([(0, dict(enumerate(root)))], "suffix long, q map<int,double>")
    levels = []
    for k in range(1, DEPTH + 1):
        seen = codes[k].groupBy(F.expr(f"code >> {BITS}").alias("context")).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct(F.expr(f"CAST(code & {SIZE - 1} AS INT)"), "n"))).alias("c"))
        both = seen.where(F.col("total") >= SUPPORT).withColumn("suffix", F.expr(f"context & {(1 << BITS * (k - 1)) - 1}L")).join(F.broadcast(up) if k <= SHORT + 1 else up, "suffix")
        gain = "aggregate(map_entries(c), 0D, (a, e) -> a + e.value * ln(e.value / total / q[e.key]))"
        level = both.select(
            "context", "total", F.expr(f"transform_values(c, (x, n) -> (n + {PRIOR}D * q[x]) / (total + {PRIOR}D))").alias("p"),
            F.expr(f"{gain} > 0.5D * size(c) * ln(total + 1)").alias("diverges"),
        )
        levels.append(C.store(level))
        up = levels[-1].select(F.col("context").alias("suffix"), F.col("p").alias("q"))
    longer = None
    for k in range(DEPTH, 0, -1):
        level = levels[k - 1]
        if longer is None:
            level = level.withColumn("retained", F.col("diverges"))
        else:
            level = level.join(longer, "context", "left").withColumn("retained", F.col("diverges") | F.col("below").isNotNull())
        levels[k - 1] = C.store(level.select("context", "total", "p", "retained"))
        longer = levels[k - 1].where("retained").select(F.expr(f"context & {(1 << BITS * (k - 1)) - 1}L").alias("context")).distinct().withColumn("below", F.lit(True))
    return Model(root, levels)


def code_logp(codes: DataFrame, model: Model) -> DataFrame:
    """code, logp (log10) of the last symbol of each code behind the longest retained suffix of the others."""
    root = "array(" + ", ".join(f"{x!r}D" for x in model.root) + ")"
    out = codes.select("code", F.expr(f"get({root}, CAST(code & {SIZE - 1} AS INT))").alias("q")).withColumn("own", F.col("q"))
    for k, level in enumerate(model.levels, 1):
        out = out.withColumn("context", F.expr(f"(code >> {BITS}) & {(1 << BITS * k) - 1}L"))
        out = out.join(F.broadcast(level) if k <= SHORT else level, "context", "left")
        q = F.expr(f"IF(total IS NULL, q, coalesce(p[CAST(code & {SIZE - 1} AS INT)], {PRIOR}D / (total + {PRIOR}D) * q))")
        out = out.select("code", q.alias("q"), "own", "retained").select("code", "q", F.expr("IF(retained, q, own)").alias("own"))
    return out.select("code", F.log10("own").alias("logp"))


@dataclass
class Tree:
    states: list[tuple[int, int]]  # (length, code); the root is first
    delta: np.ndarray  # state * SIZE + symbol -> state
    logp: np.ndarray  # state * SIZE + symbol -> log10 probability
    retained: int


def grow(found: pa.Table) -> Tree:
    """The tree of counts in memory, and its automaton: what learn() and code_logp() are held against."""
    found = found.combine_chunks()
    table, counts = np.zeros((found.num_rows, SIZE), np.float32), {}
    if found.num_rows:
        nexts = found.column("nexts").chunk(0)
        pairs = nexts.flatten()
        owner = np.repeat(np.arange(found.num_rows), np.diff(nexts.offsets.to_numpy()))
        table[owner, pairs.field("next").to_numpy()] = pairs.field("n").to_numpy()
        counts = {s: table[i] for i, s in enumerate(zip(found.column("len").to_pylist(), found.column("context").to_pylist(), strict=True))}

    def suffix(s: tuple[int, int]) -> tuple[int, int]:
        return s[0] - 1, s[1] & (1 << BITS * (s[0] - 1)) - 1

    root = (0, 0)
    base = counts.get(root, np.zeros(SIZE)).astype(float) + 1.0
    dist = {root: base / base.sum()}
    for s in sorted(counts):
        if s != root:
            up = suffix(s)
            while up not in dist:
                up = suffix(up)
            n = counts[s]
            dist[s] = (n + PRIOR * dist[up]) / (n.sum() + PRIOR)
    keep = {root}
    for s in sorted(counts, reverse=True):
        if s == root or s in keep:
            continue
        n = counts[s]
        p, q, seen = n / n.sum(), dist[suffix(s)] if suffix(s) in dist else dist[root], n > 0
        if n.sum() * (p[seen] * np.log(p[seen] / q[seen])).sum() > 0.5 * seen.sum() * math.log(n.sum() + 1):
            while s not in keep:
                keep.add(s)
                s = suffix(s)
    states = set(keep)
    for length, code in keep:  # prefixes lead to a context that isn't complete yet
        states |= {(k, code >> BITS * (length - k)) for k in range(1, length)}
    states |= {(k, s[1] & (1 << BITS * k) - 1) for s in list(states) for k in range(s[0])}
    order = sorted(states)
    number = {s: i for i, s in enumerate(order)}
    delta, logp = np.zeros((len(order), SIZE), np.int32), np.zeros((len(order), SIZE), np.float32)
    for i, (length, code) in enumerate(order):
        own = (length, code)
        while own not in keep:
            own = suffix(own)
        logp[i] = np.log10(dist[own])
        for a in range(SIZE):
            k, c = min(length + 1, DEPTH), code << BITS | a
            while (k, c & (1 << BITS * k) - 1) not in number:
                k -= 1
            delta[i, a] = number[k, c & (1 << BITS * k) - 1]
    return Tree(order, delta.ravel(), logp.ravel(), len(keep))


def score(tree: Tree, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a run. Texts are cut into chunks that are walked
    side by side; each begins DEPTH symbols early, which settles its state."""
    syms, offs = stream(off, data)
    n = len(off) - 1
    sizes = np.diff(offs) - DEPTH
    many = -(-sizes // CHUNK)
    doc = np.repeat(np.arange(n), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = offs[doc] + nth * CHUNK
    size = np.minimum(CHUNK, sizes[doc] - nth * CHUNK)
    order = np.argsort(-size, kind="stable")
    begin, size, doc = begin[order], size[order], doc[order]
    state, total = np.zeros(len(doc), np.int64), np.zeros(len(doc))
    lanes = len(doc)
    for t in range(DEPTH + CHUNK):
        lanes = int(np.searchsorted(-size[:lanes], -(t - DEPTH), "left")) if t >= DEPTH else lanes
        if not lanes:
            break
        at = state[:lanes] * SIZE + syms[begin[:lanes] + t]
        if t >= DEPTH:
            total[:lanes] += tree.logp[at]
        state[:lanes] = tree.delta[at]
    return np.bincount(doc, total, minlength=n)


def score_codes(frequent: tuple[np.ndarray, np.ndarray], off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(log10 probability of the frequent codes of each text of a run, list of its other codes)."""
    syms, offs = stream(off, data)
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(offs) - DEPTH)
    code = codes(syms, offs)
    known, logp = frequent
    some, where = np.unique(code, return_inverse=True)
    at = np.searchsorted(known, some)
    hit = np.r_[known, -1][at] == some
    out = np.bincount(doc, np.where(hit, np.r_[logp, 0.0][at], 0.0)[where], minlength=n)
    far = ~hit[where]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[far], np.arange(n + 1)), pa.int32()), pa.array(code[far]))
    return out, lists


def frequent_enough(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of counts whose n is so high that they are most at most, told from a histogram; no task sorts them."""
    step = F.floor(8 * F.log2(F.col(n)))
    have, lowest = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min(n).alias("least")).collect(), key=lambda r: -r.step):
        if have + r.rows > most:
            break
        have, lowest = have + r.rows, r.least
    return counts.where(F.col(n) >= lowest if lowest is not None else F.lit(False))


def evaluate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null or empty text is its end alone. Rows with null or repeated ids are
    scored each for themselves. Without training texts every token is unknown
    and the tree is uniform. Further columns aren't read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    train = own.where(training("doc_id")).select("body")
    counts = C.store(word_counts(train))
    n_train = train.count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, v_all = words + n_train, distinct + bool(n_train)
    deepest = C.store(code_counts(train))
    model = learn(deepest)
    first = code_logp(frequent_enough(deepest, "n", HEAD_CODES), model).toArrow()
    first = first.take(pc.sort_indices(first, sort_keys=[("code", "ascending")]))
    frequent = tuple(first.column(n).to_numpy() for n in ("code", "logp"))
    top = frequent_enough(counts, "c", HEAD)
    head = {bytes(w): (math.log10(c + 1)) for w, c in zip(*(x.to_pylist() for x in top.toArrow().columns), strict=True)}
    shared = spark.sparkContext.broadcast((frequent, head))
    listed = len(head) == distinct  # then no other word is known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, head = shared.value
        for b in batches:
            for lo, hi, off, data in C.runs(b.column(2), 2 << 20):
                part = b.slice(lo, hi - lo)
                sums, known, n, rest = [], [], [], []
                for text in part.column(2):
                    ws = [*map(_key, _words(text.as_py()))]
                    got = [*map(head.get, ws)]
                    other = []
                    if None in got:
                        other = [] if listed else [w for w, g in zip(ws, got, strict=True) if g is None]
                        got = [g for g in got if g is not None]
                    sums.append(math.fsum(got))
                    known.append(len(got))
                    n.append(len(ws) + 1)
                    rest.append(other)
                total, far = score_codes(frequent, off, data)
                yield C.batch({
                    "row": part.column(0), "doc_id": part.column(1), "n_tokens": pa.array(n, pa.int64()), "known": pa.array(known, pa.int64()),
                    "sum": pa.array(sums, pa.float64()), "score": total, "rest": pa.array(rest, pa.list_(pa.binary())), "far": far,
                })

    rows = C.store(
        own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "body").mapInArrow(run, "row long, doc_id long, n_tokens long, known long, sum double, score double, rest array<binary>, far array<long>")
    )
    tail = rows.select("row", F.explode("rest").alias("word")).join(counts, "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("plus"))
    beyond = rows.select("row", F.explode("far").alias("code"))
    plus = beyond.join(code_logp(beyond.select("code").distinct(), model), "code").groupBy("row").agg(F.sum("logp").alias("deep"))
    full = rows.drop("rest", "far").join(tail, "row", "left").join(plus, "row", "left")
    end = math.log10(n_train + 1)
    return full.select(
        "doc_id", (~training("doc_id")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + int(n_train > 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("plus", F.lit(0.0)) + end - F.col("n_tokens") * math.log10(n_all + v_all + 1)).alias("base_score"),
        (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(C.table(spark, sf_dir, "documents"))
