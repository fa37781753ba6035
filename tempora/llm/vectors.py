"""Embedding near-dedup by counting collisions of one-dimensional projections.

Each of L tables projects all vectors on one random direction and sorts them.
A query-centred window on the sorted values holds nearly all vectors within the
distance sought; two vectors collide in a table when they are in each other's
window. As one projection alone would leave each vector a fixed share of all
others, a table sorts within cells given by the signs of b further projections,
b following the number of vectors. Pairs with at least COLLISIONS collisions are
verified; L is the least number of tables at which a pair of exactly the wanted
cosine reaches that count with probability RECALL.

Equal vectors are one class. Classes within half the wanted angle of a leader form
a ball: its members are all linked with each other by the triangle inequality, so
a large group of near copies is counted, not paired. Balls whose leaders are within
the wanted angle of one form a flock, whose members may be linked or not: they are held
against each other by matrix products of blocks, and only counts and stars of their
links leave a block. Pairs are only counted and verified across flocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components, stars

COLLISIONS, RECALL, PER_CELL, ROUNDS, WIDTH = 2, 0.997, 8, 6, 2.6
#: Vectors of a block of a flock; rounds in which flocks are made; classes a partition between rounds.
BLOCK, FLOCK_ROUNDS, ROWS = 1024, 3, 50_000


def unit(col: pa.Array) -> list[bytes | None]:
    """Each vector scaled to length 1, as bytes of doubles; None for what links with nothing."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    out: list[bytes | None] = [None] * len(col)
    off = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes, given = np.diff(off), ~col.is_null().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[given & (sizes > 0)]):
        rows = np.flatnonzero(given & (sizes == n))
        x = values[off[rows][:, None] + np.arange(n)]
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        x = x[ok] / np.abs(x[ok]).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for i, v in zip(rows[ok], x, strict=True):
            out[i] = v.tobytes()
    return out


def tables(n: int, cosine: float) -> tuple[int, int]:
    """(bits of a cell, number of tables) for n vectors."""
    bits = max(1, math.ceil(math.log2(max(2, n / PER_CELL))))
    p = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(WIDTH / math.sqrt(2))
    count = COLLISIONS
    while sum(math.comb(count, k) * p**k * (1 - p) ** (count - k) for k in range(COLLISIONS)) > 1 - RECALL:
        count += 1
    return bits, count


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, n))


def _cells(signs: np.ndarray, table: int, dim: int) -> np.ndarray:
    code = signs @ (np.uint64(1) << np.arange(signs.shape[1], dtype=np.uint64))
    return C.mix(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(table * 1_000_003 + dim)).view(np.int64)


def _groups(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each dimension in a column of bytes."""
    off, data = C.binary(col)
    for size in np.unique(np.diff(off)):
        rows = np.flatnonzero(np.diff(off) == size)
        yield rows, data[off[rows][:, None] + np.arange(size)].reshape(-1).view(np.float64).reshape(len(rows), size // 8)


def _dots(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Cosines of pairs of vectors; -1 for different dimensions."""
    (oa, da), (ob, db) = C.binary(a), C.binary(b)
    out = np.full(len(oa) - 1, -1.0)
    same = np.diff(oa) == np.diff(ob)
    for size in np.unique(np.diff(oa)[same]):
        r = np.flatnonzero(same & (np.diff(oa) == size))
        x, y = ((d[o[r][:, None] + np.arange(size)].reshape(-1).view(np.float64).reshape(len(r), size // 8)) for o, d in ((oa, da), (ob, db)))
        out[r] = (x * y).sum(1)
    return out


def _cell_of(classes: DataFrame, bits: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.zeros(b.num_rows, np.int64)
            for rows, x in _groups(b.column(b.schema.get_field_index("vec"))):
                cell[rows] = _cells(x @ _directions(x.shape[1], bits, seed) > 0, seed, x.shape[1])
            yield b.append_column("cell", pa.array(cell))

    from pyspark.sql.types import LongType, StructField, StructType

    return classes.mapInArrow(run, StructType([*classes.schema.fields, StructField("cell", LongType())]))


def _cosine(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with vectors a and b replaced by their cosine."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rest = [f for f in df.schema.fields if f.name not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = x.schema.get_field_index
            cos = _dots(x.column(at(a)), x.column(at(b)))
            yield pa.RecordBatch.from_arrays([*[x.column(at(f.name)) for f in rest], pa.array(cos)], names=[*[f.name for f in rest], "cosine"])

    return df.mapInArrow(run, StructType([*rest, StructField("cosine", DoubleType())]))


def balls(classes: DataFrame, bits: int, near: float, seed: int, few: int, rounds: int = ROUNDS) -> DataFrame:
    """classes (id, n, vec) with ball: the leader to which a class has the cosine near at least, or its own id; in few partitions.

    In each round, cells pick a leader, one that has a ball already if there is one."""
    state = classes.withColumn("ball", F.lit(None).cast("long"))
    for turn in range(rounds):
        active = _cell_of(state.where("ball IS NULL OR ball = id").select("id", "vec", "ball"), bits, seed + turn)
        lead = active.groupBy("cell").agg(F.min(F.struct(F.col("ball").isNull().alias("new"), "id", "vec")).alias("lead"), F.count("*").alias("size")).where("size > 1")
        tried = active.where("ball IS NULL").join(lead, "cell").where("id != lead.id").select("id", F.col("lead.id").alias("to"), "vec", F.col("lead.vec").alias("other"))
        joined = C.cut(_cosine(tried, "vec", "other").where(F.col("cosine") >= near).select("id", "to").coalesce(few))
        if joined.isEmpty():
            continue
        moves = joined.unionByName(joined.select(F.col("to").alias("id"), "to").distinct())
        state = C.cut(state.join(moves, "id", "left").select("id", "n", "vec", F.coalesce("ball", "to").alias("ball")).coalesce(few))
    return state.withColumn("ball", F.coalesce("ball", "id"))


def _dense(cosine: float):
    """Of rows (key, side, id, ball, n, vec), sorted by key: the links of side 0 to side 1 (of all to all where there is no
    side 1) between balls, as rows (id, m: vectors linked to it, a, b: null) and stars (null, null, a, b)."""

    def links(p: pa.Table) -> pa.RecordBatch:
        p = p.combine_chunks()
        side, id_, ball, n = (p.column(c).to_numpy() for c in ("side", "id", "ball", "n"))
        ids, counts, stars_ = [], [], []
        for rows, x in _groups(p.column("vec")):
            own, other = rows[side[rows] == 0], rows[side[rows] == 1]
            y = x[side[rows] == 1] if len(other) else x[side[rows] == 0]
            two, x = other if len(other) else own, x[side[rows] == 0]
            linked = (x @ y.T >= cosine) & (ball[own][:, None] != ball[two])
            i, j = np.nonzero(linked)
            ids.append(id_[own])
            counts.append(linked @ n[two])
            if len(other):
                ids.append(id_[other])
                counts.append(n[own] @ linked)
            if len(i):
                stars_.append(stars(id_[own][i], id_[two][j]))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        a, b = (np.concatenate(z) for z in zip(*stars_, strict=True)) if stars_ else (np.zeros(0, np.int64),) * 2
        some = counts > 0
        none = [None] * len(a)
        return C.batch({
            "id": pa.array([*ids[some].tolist(), *none], pa.int64()), "m": pa.array([*counts[some].tolist(), *none], pa.int64()),
            "a": pa.array([*[None] * int(some.sum()), *a.tolist()], pa.int64()), "b": pa.array([*[None] * int(some.sum()), *b.tolist()], pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                p = pa.Table.from_batches([b.slice(lo, BLOCK)])
                key = p.column("key").to_numpy()
                while p.num_rows:
                    last = held[-1].column("key")[-1].as_py() if held else key[0]
                    end = int(np.searchsorted(key != last, True)) if (key != last).any() else len(key)
                    if held and end == 0:
                        yield links(pa.concat_tables(held))
                        held = []
                        continue
                    held.append(p.slice(0, end))
                    p, key = p.slice(end), key[end:]
        if held:
            yield links(pa.concat_tables(held))

    return run


def within(state: DataFrame, cosine: float) -> DataFrame:
    """Links within flocks (id, n, vec, ball, flock) between balls, told as by _dense()."""
    size = state.groupBy("flock").agg(F.count("*").alias("size"), F.min("ball").alias("lo"), F.max("ball").alias("hi")).where("lo < hi")
    dealt = (
        state.join(size.select("flock", "size"), "flock")
        .withColumn("k", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("k").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select(F.xxhash64("flock", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "ball", "n", "vec")
    )
    return C.cut(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_dense(cosine), "id long, m long, a long, b long"))


def _windows(width: float):
    """Pairs of rows of a cell, of different flocks, within width on the sorted projection; (key, value, id, flock) come sorted."""

    def pairs(key: np.ndarray, value: np.ndarray, id_: np.ndarray, ball: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        mixed = np.minimum.reduceat(ball, first) < np.maximum.reduceat(ball, first)
        left = np.flatnonzero(np.repeat(mixed, np.diff(np.r_[first, len(key)])))
        step = 0
        while len(left):
            step += 1
            left = left[left + step < len(key)]
            right = left + step
            ok = (key[left] == key[right]) & (value[right] - value[left] <= width)
            left, right = left[ok], right[ok]
            out = ball[left] != ball[right]
            a, b = id_[left[out]], id_[right[out]]
            if len(a):
                yield C.batch({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                cols = [np.r_[h, c] for h, c in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last cell may go on
            held = [c[cut:] for c in cols]
            yield from pairs(*[c[:cut] for c in cols])
        if held is not None:
            yield from pairs(*held)

    return run


def collisions(state: DataFrame, bits: int, count: int, cosine: float) -> DataFrame:
    """Pairs (a, b) of classes of different flocks that collide in COLLISIONS tables at least."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_, ball = b.column(0).to_numpy(), b.column(1).to_numpy()
            for rows, x in _groups(b.column(2)):
                for lo in range(0, len(rows), 4096):
                    r, y = rows[lo : lo + 4096], x[lo : lo + 4096]
                    for t in range(count):
                        z = y @ _directions(y.shape[1], bits + 1, t)
                        yield C.batch({"key": _cells(z[:, 1:] > 0, t, y.shape[1]), "value": z[:, 0], "id": id_[r], "ball": ball[r]})

    width = WIDTH * math.sqrt(2 - 2 * cosine)
    own = state.select("id", F.col("flock").alias("ball"), "vec")
    sorted_ = own.mapInArrow(project, "key long, value double, id long, ball long").repartition("key").sortWithinPartitions("key", "value")
    return sorted_.mapInArrow(_windows(width), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= COLLISIONS).select("a", "b")


def link(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors of different dimension are not compared. Null, empty and zero vectors
    and those with null or non-finite components link with nothing; rows with a
    null id likewise, and are kept. Rows that repeat an id count as one vector more
    each. Further columns aren't read.
    """
    C.ready(vectors.sparkSession)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield C.batch({"vec_id": b.column(0), "vec": pa.array(unit(b.column(1)), pa.binary())})

    rows = C.cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(units, "vec_id long, vec binary"))
    fit = rows.where("vec IS NOT NULL AND vec_id IS NOT NULL")
    classes = C.cut(fit.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("id", "n", "vec"))
    size = classes.count()
    bits, count = tables(size, cosine)
    few = max(4, -(-size // ROWS))
    state = balls(classes, bits, math.cos(math.acos(cosine) / 2) + 1e-9, 1000, few)
    # a ball goes to the flock of its leader
    flocks = balls(state.where("ball = id").select("id", "n", "vec"), bits, cosine, 2000, few, FLOCK_ROUNDS).select(F.col("id").alias("ball"), F.col("ball").alias("flock"))
    state = C.cut(state.join(flocks, "ball").coalesce(few))
    dense = within(state, cosine)
    vec = state.select("id", "vec", "n")
    found = collisions(state, bits, count, cosine)
    both = found.join(vec.toDF("a", "va", "na"), "a").join(vec.toDF("b", "vb", "nb"), "b")
    links = C.cut(_cosine(both, "va", "vb").where(F.col("cosine") >= cosine))
    owned = state.select("id", "ball", "n")
    cross = links.select(F.col("a").alias("id"), F.col("nb").alias("m")).unionByName(links.select(F.col("b").alias("id"), F.col("na").alias("m"))).unionByName(dense.where("id IS NOT NULL").select("id", "m"))
    cross = cross.groupBy("id").agg(F.sum("m").alias("m"))
    sizes = owned.groupBy("ball").agg(F.sum("n").alias("all"))
    edges = owned.where("ball != id").select(F.col("ball").alias("a"), F.col("id").alias("b")).unionByName(links.select("a", "b")).unionByName(dense.where("a IS NOT NULL").select("a", "b"))
    comp = components(edges).toDF("id", "component")
    full = owned.join(sizes, "ball").join(cross, "id", "left").join(comp, "id", "left").select("id", (F.col("all") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    own = fit.join(classes.select("vec", "id"), "vec").select("vec_id", "id").join(full, "id").select("vec_id", "n_links", "component_id")
    rest = rows.where("vec IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(C.table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """All pairs, and components by recursion."""
    return """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
          WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
    r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
    c AS (SELECT v.vec_id, least(v.vec_id, min(r.y)) AS component_id FROM v LEFT JOIN r ON r.x = v.vec_id GROUP BY v.vec_id),
    n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
    SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, component_id = c.vec_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id"""
