"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items, cut into overlapping pieces where they are long, are indexed by
their character q-grams. A document's q-grams that the index holds lie on
diagonals (position in the document less position in the piece); they are counted
in overlapping bands of diagonals. Two strings of which one has m characters and
that differ by e edits share at least m - q + 1 - q e q-grams, all within a band
as wide as the edits can shift, so only bands with that many are verified, by
edit distance aligned within the band.

Comparison is on UTF-8 bytes, ASCII letters in lower case and white space as one
kind of character. An item of q bytes or less is too short to identify within a text:
it is found where it is the whole text, blanks around it aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

Q, ERRORS, WHOLE, PIECE, STEP = 8, 0.1, 256, 192, 96
#: Bytes of benchmark text indexed and broadcast at once (about 40 times as much memory, if all is in pieces); a larger
#: benchmark takes a pass over the documents for each, one index at a time.
BLOCK = 8 << 20
#: A text that is one short item and blanks around it has so many bytes at most.
SHORT_TEXT = 1 << 12

_FOLD = C.LOWER.copy()
_FOLD[np.flatnonzero(C.SPACE)] = 0x20


@dataclass
class Index:
    items: np.ndarray  # item id of each piece
    pieces: list[bytes]
    edits: np.ndarray
    need: np.ndarray  # least number of shared q-grams
    grams: np.ndarray  # sorted
    first: np.ndarray  # of each gram's postings
    piece: np.ndarray  # postings
    place: np.ndarray
    filter: np.ndarray
    short: dict[bytes, list[int]]  # items of Q bytes or less


def grams(d: np.ndarray) -> np.ndarray:
    """The q = 8 bytes from each position as one number."""
    if len(d) < Q:
        return np.zeros(0, np.uint64)
    x = d.astype(np.uint64)
    for n in (1, 2, 4):
        x = x[:-n] << np.uint64(8 * n) | x[n:]
    return x


def slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def build(items: list[tuple[int, bytes]]) -> Index:
    pieces, owner, short = [], [], {}
    for i, text in items:
        t = _FOLD[np.frombuffer(text, np.uint8)].tobytes()
        if 0 < len(t.strip()) <= Q:
            short.setdefault(t.strip(), []).append(i)
        at = [0] if len(t) <= WHOLE else [*range(0, len(t) - PIECE, STEP), len(t) - PIECE]
        for a in at:
            p = t if len(t) <= WHOLE else t[a : a + PIECE]
            if len(p) > Q:
                pieces.append(p)
                owner.append(i)
    m = np.array([len(p) for p in pieces], np.int64)
    edits = np.minimum((ERRORS * m).astype(np.int64), np.maximum(0, (m - Q) // Q))
    all_g = [grams(np.frombuffer(p, np.uint8)) for p in pieces]
    g = np.concatenate([*all_g, np.zeros(0, np.uint64)])
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(x) for x in all_g])
    place = np.concatenate([*[np.arange(len(x), dtype=np.int16) for x in all_g], np.zeros(0, np.int16)])
    order = np.argsort(g, kind="stable")
    unique, first = np.unique(g[order], return_index=True)
    bits = np.zeros(1 << 20, bool)
    bits[slot(unique)] = True
    return Index(np.array(owner, np.int64), pieces, edits, m - Q + 1 - Q * edits, unique, np.r_[first, len(g)].astype(np.int32), piece[order], place[order], bits, short)


def aligned(piece: bytes, region: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the place in region nearest to piece, of the least edits and then the
    first end; None over most. Columns are the diagonals that most edits can reach between a start and an end in the region."""
    if (at := region.find(piece)) >= 0:
        return 0, at, at + len(piece)
    t, n = np.frombuffer(region, np.uint8).astype(np.int16), len(region)
    width = n - len(piece) + 2 * most + 1  # diagonals -most .. n - m + most
    if width <= 0:
        return None
    lo = -most
    steps = np.arange(width)
    # cell (i, k): i characters of the piece against the region up to i + lo + k
    cost = np.where((steps + lo >= 0) & (steps + lo <= n), 0, 1 << 20)
    begin = steps + lo
    for i, c in enumerate(piece, 1):
        j = steps + lo + i
        inside = (j >= 1) & (j <= n)
        same = np.ones(width, np.int64)
        same[inside] = t[j[inside] - 1] != c
        diag = np.where(inside, cost + same, 1 << 20)
        up = np.r_[cost[1:] + 1, 1 << 20]
        take = up < diag
        new, src = np.where(take, up, diag), np.where(take, np.r_[begin[1:], 0], begin)
        new[(j < 0) | (j > n)] = 1 << 20
        run = new - steps
        best = np.minimum.accumulate(run)
        at = np.maximum.accumulate(np.where(run == best, steps, 0))
        cost, begin = best + steps, src[at]
        cost[(j < 0) | (j > n)] = 1 << 20
        if i % 16 == 0 and cost.min() > most:
            return None
    k = int(cost.argmin())
    return (int(cost[k]), max(0, int(begin[k])), k + lo + len(piece)) if cost[k] <= most else None


def hits(ix: Index, off: np.ndarray, data: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document number, item, start, end, edits) of each item found in a run, once an item and document: the fewest edits, then the first."""
    d = _FOLD[data]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in np.flatnonzero(np.diff(off) <= SHORT_TEXT) if ix.short else []:
        raw = d[off[i] : off[i + 1]].tobytes()
        for item in ix.short.get(raw.strip(), []):
            s = len(raw) - len(raw.lstrip())
            found[int(i), item] = (0, s, s + len(raw.strip()))
    g = grams(d)
    at = np.flatnonzero(ix.filter[slot(g)]) if len(ix.grams) else np.zeros(0, np.int64)
    doc = np.searchsorted(off, at, "right") - 1
    ok = at + Q <= off[doc + 1]
    at, doc = at[ok], doc[ok]
    k = np.minimum(np.searchsorted(ix.grams, g[at]), max(0, len(ix.grams) - 1))
    ok = ix.grams[k] == g[at] if len(at) else np.zeros(0, bool)
    at, doc, k = at[ok], doc[ok], k[ok]
    for part in np.array_split(np.arange(len(at)), 1 + int((ix.first[k + 1] - ix.first[k]).sum()) // 2_000_000) if len(at) else []:
        _regions(ix, off, d, at[part], doc[part], k[part], found)
    return [(doc_, item, s, e, n) for (doc_, item), (n, s, e) in sorted(found.items())]


def _regions(ix: Index, off: np.ndarray, d: np.ndarray, at: np.ndarray, doc: np.ndarray, k: np.ndarray, found: dict) -> None:
    many = (ix.first[k + 1] - ix.first[k]).astype(np.int64)
    post = np.repeat(ix.first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at, doc, piece = np.repeat(at, many), np.repeat(doc, many), ix.piece[post].astype(np.int64)
    diagonal = at - off[doc] - ix.place[post].astype(np.int64)
    width = 2 * ix.edits[piece] + 1  # bands of twice this width begin at each multiple of it
    band = np.floor_divide(diagonal, width)
    keys = np.concatenate([np.stack([doc, piece, b]) for b in (band, band - 1)], axis=1)
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    new = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
    count = np.diff(np.r_[new, keys.shape[1]])
    passing = count >= ix.need[keys[1, new]]
    places = np.concatenate([ix.place[post]] * 2)[order]
    for j in np.flatnonzero(passing):  # a repetitive text has the same q-gram again and again: it counts once
        passing[j] = len(np.unique(places[new[j] : new[j] + count[j]])) >= ix.need[keys[1, new[j]]]
    for doc_, p, b in keys[:, new[passing]].T.tolist():
        e, size = int(ix.edits[p]), 2 * int(ix.edits[p]) + 1
        item = int(ix.items[p])
        text_end, begin = int(off[doc_ + 1] - off[doc_]), int(off[doc_])
        lo = max(0, b * size - e)
        hi = min(text_end, (b + 2) * size + len(ix.pieces[p]) + e)
        if (best := found.get((doc_, item))) and best[0] == 0 and best[1] <= lo:
            continue
        if got := aligned(ix.pieces[p], d[begin + lo : begin + hi].tobytes(), e):
            n, s, t = got
            if best is None or (n, lo + s) < best[:2]:
                found[doc_, item] = (n, lo + s, lo + t)


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of at most BLOCK bytes of items each, so that what is broadcast is bounded whatever the benchmark's size."""
    held, size = [], 0
    for row in benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        raw = row[1].encode()
        if held and size + len(raw) > BLOCK:
            yield build(held)
            held, size = [], 0
        held.append((int(row[0]), raw))
        size += len(raw)
    yield build(held)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, edits for each benchmark item found in each document.

    start and end are byte offsets of the place (of the first piece that matches
    best, where an item is long). Null and empty texts and items have none; an
    empty benchmark finds nothing; rows with a null or repeated id count each for
    themselves; further columns are not read.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("_t"))
    out = None
    for ix, last in _told(blocks(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, _, off, data in C.runs(b.column(1)):
                    if got := hits(shared.value, off, data):
                        doc, item, s, e, n = map(list, zip(*got, strict=True))
                        ids = b.column(0).take(pa.array([lo + i for i in doc], pa.int64()))
                        yield C.batch({"doc_id": ids, "item_id": pa.array(item, pa.int64()), "start": pa.array(s, pa.int64()), "end": pa.array(e, pa.int64()), "edits": pa.array(n, pa.int32())})

        part = own.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits int")
        if out is not None or not last:  # what was found is written, so that the index can go
            part = C.store(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _told(blocks: Iterator[Index]) -> Iterator[tuple[Index, bool]]:
    """Each index, and whether it is the last one."""
    held = next(blocks, None)
    while held is not None:
        after = next(blocks, None)
        yield held, after is None
        held = after


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, all columns, in which no benchmark item is found."""
    several = False
    for ix, last in _told(blocks(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(ix)

        def free(off: np.ndarray, data: np.ndarray, shared=shared) -> np.ndarray:
            keep = np.ones(len(off) - 1, bool)
            keep[[i for i, *_ in hits(shared.value, off, data)]] = False
            return keep

        docs = docs.where(C.flags(free)(docs[text_col]))
        if several or not last:
            several, docs = True, C.store(docs)
            shared.destroy()
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
