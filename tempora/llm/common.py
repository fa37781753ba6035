"""What the training-data operators share: tables, checkpoints and vectorised views of text.

Texts are handled as UTF-8 bytes straight from Arrow buffers, in runs of rows of
about a megabyte, so memory follows neither the batch nor the longest document's
neighbours. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder: the session's own. Without one only a local
    session gets a temporary one; a cluster's executors couldn't share it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names."""
    sc = spark.sparkContext
    if told := sc.getConf().get("spark.checkpoint.dir"):
        return told
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into the shared checkpoint folder; lost executors don't matter afterwards."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table beside the checkpoints: compact, for what is large."""
    ready(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or not len(col):
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off, data


def runs(col: pa.Array, limit: int = RUN_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets, bytes) of runs of whole texts, of
    about limit bytes together unless one text alone is longer, and so many rows at most."""
    off, data = binary(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1), i + rows)
        yield i, j, off[i : j + 1] - off[i], data[off[i] : off[j]]
        i = j


def words(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document number) of the words of a run."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if _powers.get(0) is None or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, b in ((0, _BASE), (1, _INV)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial rolling hash; see span()."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end)."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Words that are longer are hashed one by one.
LONG = 256
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_STIR = np.random.default_rng(61).integers(0, 2**63, 128, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), under 1000 bytes each, eight bytes at a time; every step is mixed,
    so no family of strings collides by algebra (as it does under a polynomial modulo 2^64). Equal hashes of
    different strings are a matter of 2^-64 a pair."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    size = ends - starts
    out = size.astype(np.uint64) * _STIR[-1]
    whole = int(size.min()) // 8
    for k in range(whole):
        out = mix((out ^ eight[starts + 8 * k]) * _STIR[k])
    left, k = np.flatnonzero(size > 8 * whole), whole
    while len(left):
        part = eight[starts[left] + 8 * k] & _MASK[np.minimum(size[left] - 8 * k, 8)]
        out[left] = mix((out[left] ^ part) * _STIR[k])
        k += 1
        left = left[size[left] > 8 * k]
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """string_hashes() of words of any length."""
    size = ends - starts
    long = np.flatnonzero(size > LONG)
    if not len(long):
        return string_hashes(data, starts, ends)
    out = string_hashes(data, starts, np.minimum(ends, starts + LONG))
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def trim() -> None:
    """Give what a task no longer needs back to the system; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def flags(f: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int = 4096) -> Callable[..., Column]:
    """A column function: f(offsets, bytes) -> a boolean for each text of a run. Only texts go to Python and only
    flags come back; the other columns stay in the JVM."""

    def run(col: pa.Array) -> pa.Array:
        out = [np.asarray(f(off, data), bool) for *_, off, data in runs(col, rows=rows)]
        trim()
        return pa.array(np.concatenate([*out, np.zeros(0, bool)]))

    run.__annotations__ = {"col": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "boolean")


#: Bytes of text that a model is fitted on at most; texts are taken whole, in order, as long as they fit.
SAMPLE_BYTES = 64 << 20


def sample_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> pa.Table:
    """The whole texts of a few documents, brought to the driver; ids has an explicit limit and tells their _order."""
    picked = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(ids), "_id")
    upto = F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")).over(Window.orderBy("_order", "_id", F.xxhash64("_text")).rowsBetween(Window.unboundedPreceding, 0))
    return picked.withColumn("_bytes", upto).where(F.col("_bytes") <= SAMPLE_BYTES).drop("_bytes", "_order").toArrow()


def batch(cols: dict[str, object], types: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=(types or {}).get(k)) for k, v in cols.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(cols))
