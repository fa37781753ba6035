"""MinHash near-dedup with HyperMinHash registers.

A document's signature has M registers; register i keeps of the least value of
the i-th hash over the document's shingles only the number of leading zeros and
the BITS bits behind the first one, 16 bits in all. (Each register has a hash
function of its own instead of a share of one function's values, so that short
documents have no empty registers.) Bands of registers are hashed to buckets;
two documents of a bucket are candidates if the share of equal registers, less
what unequal minima give by chance, is no lower than what a pair at the threshold
falls below with a probability of MISS; candidates are verified on their full
shingle sets.

Only links that matter are looked for: documents with equal sets are one class
from the start, and a pair within a component that is already connected is never
verified. In the first round every class proposes its best candidate in each
bucket. In the last one all candidates that remain between components count: those
of a bucket with few pairs a class are verified pair by pair; those of one with more
are gathered to clusters, and the sets of a cluster are verified in blocks, so that no
table holds the pairs of a large group and no chain of buckets makes a cluster. Large
buckets are dealt out in pairs of blocks of BLOCK classes, too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components, stars

M, ROWS, BITS = 128, 4, 10
#: Probability that a pair at the threshold has too few equal registers to be verified.
MISS = 1e-6
BLOCK, ROUNDS = 512, 2
#: Candidate pairs a class from which on a bucket's candidates are verified in blocks.
DENSE = 2
#: Shingles of a block of sets that are verified against another block's.
BLOCK_HASHES = 1 << 16

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**63, M, dtype=np.int64).astype(np.uint64)
_MUL = _rng.integers(0, 2**63, M, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.array([0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xB492B66FBE98F273], np.uint64)


def shingles(off: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of the distinct shingles of k words of a run, sorted by document and hash.

    A document of fewer words has one, its whole sequence; without words none."""
    low = C.LOWER[data]
    s, e, d = C.words(off, low)
    h = C.word_hashes(low, s, e)
    if not len(h):
        return h, d
    n = max(0, len(h) - k + 1)
    whole = np.zeros(n, np.uint64)
    for j in range(k):
        whole += h[j : j + n] * _STEP[j]
    same = d[:n] == d[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    out, doc = C.mix(whole[same]), d[:n][same]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    size = np.diff(np.r_[first, len(d)])
    if (short := size < k).any():
        place = np.arange(len(h)) - np.repeat(first, size)
        sums = np.add.reduceat(h * _STEP[np.minimum(place, k - 1)], first) + size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        out, doc = np.r_[out, C.mix(sums[short])], np.r_[doc, d[first[short]]]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])]
    return out[new], doc[new]


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, one row for each run of h that begins at first."""
    out = np.empty((len(first), M), np.uint16)
    for i in range(M):
        v = np.minimum.reduceat((h ^ _XOR[i]) * _MUL[i], first)
        zeros = np.where(v == 0, 63, 63 - np.floor(np.log2(np.maximum(v, np.uint64(1)).astype(np.float64))).astype(np.int64)).clip(0, 63)
        rest = (v << (zeros + 1).clip(0, 63).astype(np.uint64)) >> np.uint64(64 - BITS)
        out[:, i] = zeros << BITS | rest.astype(np.int64)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A bucket number for each band of each signature."""
    x = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), M // ROWS)
    return C.mix(x + np.arange(M // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


#: Unequal minima share a register with about this probability: the leading zeros agree in about a third of cases, then BITS bits.
CHANCE = 2.0**-BITS / 2


def least_equal(percent: int) -> int:
    """The most registers that a pair whose similarity is percent has equal but for a probability of MISS.

    Each is equal with that similarity's probability at least, so this is a binomial bound."""
    p, below = percent / 100, 0.0
    for n in range(M + 1):
        below += math.comb(M, n) * p**n * (1 - p) ** (M - n)
        if below > MISS:
            return n
    return M


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit digest of the set's sorted hashes), sig (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, off, data in C.runs(b.column(1)):
                n = hi - lo
                h, doc = shingles(off, data, k)
                size = np.bincount(doc, minlength=n)
                digests = np.zeros((2, n), np.uint64)
                sig = [None] * n
                if len(h):
                    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    own = doc[first]
                    for i, row, a, z in zip(own.tolist(), registers(h, first), first.tolist(), [*first[1:].tolist(), len(h)], strict=True):
                        sig[i] = row.tobytes()
                        digests[:, i] = np.frombuffer(hashlib.blake2b(h[a:z], digest_size=16).digest(), np.uint64)
                yield C.batch({"doc_id": b.column(0).slice(lo, n), "n_shingles": size.astype(np.int64), "set_a": digests[0].view(np.int64), "set_b": digests[1].view(np.int64), "sig": pa.array(sig, pa.binary())})

    schema = "doc_id long, n_shingles long, set_a long, set_b long, sig binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(run, schema)


def buckets(classes: DataFrame) -> DataFrame:
    """id, sig, bucket for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                p = b.slice(lo, 2048)
                sig = np.frombuffer(b"".join(p.column(1).to_pylist()), np.uint16).reshape(p.num_rows, M)
                n = M // ROWS
                rows = np.repeat(np.arange(p.num_rows), n)
                yield C.batch({"id": p.column(0).take(pa.array(rows)), "bucket": bands(sig).ravel()})

    return classes.select("id", "sig").mapInArrow(run, "id long, bucket long")


def sets(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, off, data in C.runs(b.column(1)):
                h, doc = shingles(off, data, k)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield C.batch({"id": b.column(0).slice(lo, hi - lo), "hashes": pa.LargeListArray.from_arrays(ends, pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")).mapInArrow(run, "id long, hashes array<long>")


def _pairs(group: np.ndarray, side: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within a group that differ in component and, where a group has both, in side."""
    both = np.zeros(len(group), bool)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    both = np.repeat(np.maximum.reduceat(side, first) > 0, np.diff(np.r_[first, len(group)]))
    left, step = np.arange(len(group)), 0
    while len(left):
        step += 1
        left = left[left + step < len(group)]
        left = left[group[left] == group[left + step]]
        ok = (comp[left] != comp[left + step]) & (~both[left] | (side[left] != side[left + step]))
        if ok.any():
            yield left[ok], left[ok] + step


def _propose(turn: int, least: int, dense: int):
    """Candidates between the components of buckets, or of pairs of their blocks; rows come sorted by bucket, i, j.

    A pair is a matter of the first bucket that both share. In all turns but the
    last a class proposes its best partner; in the last one candidates are told as they
    are (est 0) or, in buckets of many, as stars of their components (est 1)."""
    last = turn == ROUNDS - 1

    def some(bucket: np.ndarray, group: np.ndarray, side: np.ndarray, ids: np.ndarray, comp: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        band = bands(sig)
        at = (band == bucket[:, None]).argmax(1)
        left, right, est = [], [], []
        for x, y in _pairs(group, side, comp):
            for lo in range(0, len(x), 1 << 14):
                i, j = x[lo : lo + (1 << 14)], y[lo : lo + (1 << 14)]
                mine = ((band[i] == band[j]).argmax(1)) == at[i]
                i, j = i[mine], j[mine]
                same = sig[i] == sig[j]
                share = (same.mean(1) - CHANCE) / (1 - CHANCE)
                ok = same.sum(1) >= least
                left.append(i[ok])
                right.append(j[ok])
                est.append(share[ok])
        i, j, e = (np.concatenate([*v, np.zeros(0, t)]).astype(t) for v, t in ((left, int), (right, int), (est, float)))
        x, a, b = np.r_[ids[i], ids[j]], np.r_[ids[i], ids[j]], np.r_[ids[j], ids[i]]
        if last:
            n = int(group[-1]) + 1
            many = (np.bincount(group[i], minlength=n) > dense * np.bincount(group, minlength=n))[group[i]]
            centre, node = stars(ids[i[many]], ids[j[many]])
            a, b = np.r_[ids[i[~many]], centre], np.r_[ids[j[~many]], node]
            x, e = a, np.repeat([0.0, 1.0], [int((~many).sum()), len(centre)])
        else:
            e = np.r_[e, e]
            order = np.lexsort((np.maximum(a, b), np.minimum(a, b), -e, x))
            order = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(order) else order
            x, a, b, e = x[order], a[order], b[order], e[order]
        return C.batch({"x": x, "a": np.minimum(a, b), "b": np.maximum(a, b), "est": e})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                p = pa.Table.from_batches([b.slice(lo, 4096)])
                held = p if held is None else pa.concat_tables([held, p])
                if held.num_rows < 4096:
                    continue
                held = held.combine_chunks()
                keys = [held.column(n).to_numpy() for n in ("bucket", "i", "j")]
                tail = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
                end = int(tail[-1]) + 1 if len(tail) else 0  # the last group may go on
                if end:
                    yield part(held.slice(0, end))
                    held = held.slice(end)
        if held is not None and held.num_rows:
            yield part(held.combine_chunks())

    def part(p: pa.Table) -> pa.RecordBatch:
        p = p.combine_chunks()
        bucket, i, j, ids, comp, side = (p.column(n).to_numpy() for n in ("bucket", "i", "j", "id", "component", "side"))
        off, data = C.binary(p.column("sig"))
        sig = data[off[0] : off[-1]].copy().view(np.uint16).reshape(p.num_rows, M)
        group = np.cumsum(np.r_[False, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        return some(bucket, group, side, ids, comp, sig)

    return run


def candidates(members: DataFrame, reps: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a bucket and may be similar enough; in the last turn with
    dense, which marks stars of them."""
    held = members.join(labels, "id")
    mixed = held.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    dealt = (
        held.join(mixed.select("bucket", "size"), "bucket")
        .withColumn("n", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("own", F.when(F.col("n") > 1, F.pmod(F.xxhash64("id"), F.col("n").cast("long")).cast("int")).otherwise(0))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    )
    signed = dealt.join(reps, "id").select("bucket", "i", "j", "id", "component", "sig", "side")
    pairs = signed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_propose(turn, least_equal(percent), DENSE), "x long, a long, b long, est double")
    if turn == ROUNDS - 1:
        return pairs.select("a", "b", (F.col("est") > 0).alias("dense")).distinct()
    best = pairs.groupBy("x").agg(F.max(F.struct("est", "a", "b")).alias("p"))
    return best.select("p.a", "p.b").distinct()


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets satisfy 100 * intersection >= percent * union."""
    one = held.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    two = held.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _blocks(percent: int):
    """Stars of the links between components in groups of rows (key, id, component, side, hashes), sorted by key.

    Rows of side 0 are held against those of side 1, or against each other where a group has no side 1."""

    def links(p: pa.Table) -> pa.RecordBatch:
        p = p.combine_chunks()
        key, ids, comp, side = (p.column(n).to_numpy() for n in ("key", "id", "component", "side"))
        lists = p.column("hashes").chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        n = len(ids)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
        both = np.maximum.reduceat(side, first)[group] > 0
        row = np.repeat(np.arange(n), size)
        h = C.mix(lists.flatten().to_numpy().view(np.uint64) + group[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        mine, other = (~both | (side == 0))[row], (~both | (side == 1))[row]
        order = np.argsort(h[other], kind="stable")
        yh, yr = h[other][order], row[other][order]
        xh, xr = h[mine], row[mine]
        lo = np.searchsorted(yh, xh, "left")
        many = np.searchsorted(yh, xh, "right") - lo
        upto = np.r_[0, np.cumsum(np.bincount(xr, many, minlength=n))]
        a, b, r0 = [], [], 0
        while r0 < n:
            r1 = max(r0 + 1, int(np.searchsorted(upto, upto[r0] + 2_000_000, "right")) - 1)
            e = slice(*np.searchsorted(xr, [r0, r1]))
            m = many[e]
            post = np.repeat(lo[e] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            code, common = np.unique(np.repeat(xr[e], m) * n + yr[post], return_counts=True)
            x, y = code // n, code % n
            ok = (comp[x] != comp[y]) & (100 * common >= percent * (size[x] + size[y] - common))
            a.append(ids[x[ok]])
            b.append(ids[y[ok]])
            r0 = r1
        centre, node = stars(np.concatenate(a), np.concatenate(b))
        return C.batch({"a": centre, "b": node})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                held.append(p := pa.Table.from_batches([b.slice(lo, 128)]))
                size += len(p.column("hashes").chunk(0).flatten())
                if size < 2 * BLOCK_HASHES:
                    continue
                whole = pa.concat_tables(held)
                key = whole.column("key").to_numpy()
                end = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if end:
                    yield links(whole.slice(0, end))
                    held = [whole.slice(end)]
                    size = int(pc.sum(pc.list_value_length(held[0].column("hashes"))).as_py())
        if held and sum(p.num_rows for p in held):
            yield links(pa.concat_tables(held))

    return run


def verified_in_blocks(pairs: DataFrame, labels: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Stars of the links between components of the clusters that the pairs (a, b) make.

    A cluster's components of many classes have blocks of their own, which aren't held
    against each other; the other components' classes are dealt to blocks together."""
    member = components(pairs).toDF("id", "cluster").join(labels, "id").join(held.select("id", F.size("hashes").cast("long").alias("size")), "id")
    member = C.cut(member.select("id", "cluster", "component", "size"))
    count = [F.sum("rows").alias("rows"), F.sum("size").alias("size")]
    parts = member.groupBy("cluster", "component").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    parts = parts.withColumn("tag", F.when((F.col("rows") > BLOCK) | (F.col("size") > BLOCK_HASHES), F.col("component")))
    blocks = parts.groupBy("cluster", "tag").agg(*count).withColumn("n", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("size") / BLOCK_HASHES)).cast("int"))
    plan = blocks.groupBy("cluster").agg(F.collect_list(F.struct("tag", "n")).alias("plan"))
    own = member.join(plan, "cluster").withColumn("tag", F.expr("get(filter(plan, p -> p.tag = component), 0).tag"))
    own = own.withColumn("own", F.expr("struct(tag, pmod(xxhash64(id), get(filter(plan, p -> p.tag <=> tag), 0).n) AS k)"))
    others = "flatten(transform(filter(plan, p -> p.tag IS NULL OR tag IS NULL OR p.tag != tag), p -> transform(sequence(0L, p.n - 1L), k -> struct(p.tag AS tag, k AS k))))"
    dealt = own.select("id", "cluster", "component", "own", F.explode(F.expr(others)).alias("other"))
    dealt = dealt.select("id", "component", F.expr("xxhash64(cluster, least(own, other), greatest(own, other))").alias("key"), F.expr("IF(own <= other, 0, 1)").alias("side"))
    groups = dealt.join(held, "id").select("key", "id", "component", "side", "hashes")
    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(_blocks(percent), "a long, b long")


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null and empty texts have no shingles and are linked with nothing. A component's id
    is its smallest doc_id, null if it has none. Where doc_ids repeat or are null, rows
    are told apart: of a component one row is kept, the first by doc_id. Further columns
    aren't read, whatever they are called.
    """
    C.ready(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = C.cut(signatures(own, k, "doc_id", "text"))
    if not _ambiguous(rows):
        return _link(own, rows, k, percent)
    told = _numbered(own, "doc_id")
    found = C.cut(_link(told.select(F.col("_row").alias("doc_id"), "text"), None, k, percent))
    names = told.select(F.col("_row"), F.col("doc_id").alias("name"))
    first = names.select(F.col("_row").alias("component_id"), F.col("name").alias("smallest"))
    return (
        found.join(names, found.doc_id == names._row).join(first, "component_id")
        .select(F.col("name").alias("doc_id"), "n_shingles", F.col("smallest").alias("component_id"), "kept")
    )


def _ambiguous(rows: DataFrame) -> bool:
    """Whether a doc_id is null or repeats."""
    return not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()


def _numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """docs, stored, with _row: a number that grows with the id, nulls last."""
    return C.store(docs.orderBy(F.col(id_col).asc_nulls_last()).withColumn("_row", F.monotonically_increasing_id()))


def _link(docs: DataFrame, rows: DataFrame | None, k: int, percent: int) -> DataFrame:
    """link() of doc_id (unique, not null) and text; rows: the result of signatures(), if it is there already."""
    id_col, text_col = "doc_id", "text"
    rows = C.cut(signatures(docs, k, id_col, text_col)) if rows is None else rows
    filled = rows.where("n_shingles > 0")
    classes = filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"))
    reps = filled.join(classes.withColumnRenamed("id", "doc_id"), ["set_a", "set_b", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "sig").dropDuplicates(["id"])
    spread = buckets(reps)
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = C.store(spread.join(shared, "bucket").select("id", "bucket"))
    ids = C.cut(members.select("id").distinct())
    reps = C.store(reps.join(ids, "id", "left_semi"))
    texts = docs.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi")
    held = C.cut(sets(texts, k, id_col, text_col).dropDuplicates(["id"]))
    labels, edges = ids.withColumn("component", F.col("id")), None
    for turn in range(ROUNDS):
        pairs = candidates(members, reps, labels, turn, percent)
        if turn < ROUNDS - 1:
            found = C.cut(verified(pairs, held, percent))
        else:
            pairs = C.cut(pairs)
            found, dense = verified(pairs.where("NOT dense"), held, percent), pairs.where("dense").select("a", "b")
            found = C.cut(found if dense.isEmpty() else found.unionByName(verified_in_blocks(dense, labels, held, percent)))
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.unionByName(found)
        labels = ids.join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    by_class = classes.join(labels, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component"))
    owned = filled.join(by_class, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component")
    rest = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return owned.unionByName(rest).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(C.table(spark, sf_dir, "documents"), k=4)


def dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are kept: of each component the one of smallest doc_id.

    Where ids repeat or are null one row of each component stays all the same. Texts without shingles stay."""
    C.ready(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = C.cut(signatures(own, k, "doc_id", "text"))
    if not _ambiguous(rows):
        gone = _link(own, rows, k, percent).where("NOT kept").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    told = _numbered(docs, id_col)
    gone = _link(told.select(F.col("_row").alias("doc_id"), F.col(text_col).alias("text")), None, k, percent).where("NOT kept").select(F.col("doc_id").alias("_row"))
    return told.join(gone, "_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
