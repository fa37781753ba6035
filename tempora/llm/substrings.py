"""Removal of repeated substrings with a logarithmic family of suffix arrays.

Every LENGTH-byte string has an anchor: the CORE-byte gram of least hash in it.
Equal strings have equal anchors at the same place, so only texts around equal
anchors are compared. A segment is an anchor with all bytes that a LENGTH-byte
string around it can reach.

1. Texts are collapsed to distinct ones by digest; a copied text repeats as a whole.
2. Anchors are grouped by (core, segment): a segment that occurs again repeats as a
   whole. Much repetition ends here, in partial aggregates.
3. Segments that occur once but share their anchor with others are compared by
   suffix arrays. They come in batches, whatever anchors they have; a batch is sorted,
   scanned for equal neighbours, merge-scanned against the sorted levels of the
   batches before it, and levels of equal size are merged. A level keeps one entry of
   equal ones.

A segment's suffixes are compared STEP places at a time, where they agree on
LENGTH - STEP bytes (a part, known by its hash and its anchor's) and only the bytes at
both ends can differ: levels hold parts, and a part's suffixes enter the levels of
suffixes as soon as another one agrees with it. Anchors with more than HOT segments
are dealt out by parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH, CORE, STEP, HOT, BATCH = 400, 100, 30, 512, 2048
#: Parts and suffixes that a task holds before it drops those of anchors that it is done with.
HELD = 500_000
SHARES = 1000
REACH = LENGTH - CORE


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) of each width consecutive values."""
    size = 1
    while 2 * size <= width:
        x = take(x[:-size], x[size:])
        size *= 2
    return take(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, place, core hash, segment hash) of the anchors of a run, places in the run."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    if n < LENGTH:
        return none
    sums = C.prefix(data)
    at = np.arange(n - CORE + 1)
    gram = C.span(sums, at, at + CORE) | np.uint64(1)
    least = _slide(gram, REACH + 1, np.minimum)  # of each string of LENGTH bytes
    valid = np.zeros(len(least), bool)
    for a, b in zip(off[:-1], off[1:], strict=True):
        valid[a : max(a, b - LENGTH + 1)] = True
    least[~valid] = 0
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    place = np.flatnonzero(_slide(padded, REACH + 1, np.maximum) == gram)
    text = np.searchsorted(off, place, "right") - 1
    lo, hi = np.maximum(off[text], place - REACH), np.minimum(off[text + 1], place + LENGTH)
    seg = C.mix(C.string_hashes(data, lo, hi) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - place).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return text, place, gram[place], seg


class Family:
    """Sorted arrays of keys and their owners, each at least twice as long as the next; a key is kept once."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.merges = 0

    def __len__(self) -> int:
        return sum(len(keys) for keys, _ in self.levels)

    def add(self, keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Insert keys; pairs of owners (new, new or old) of equal ones, which leave no key without mention that isn't alone."""
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        pairs = []
        if len(keys):
            same = keys[1:] == keys[:-1]
            pairs.append((owner[1:][same], owner[:-1][same]))
            first = np.r_[True, ~same]
            keys, owner = keys[first], owner[first]
        known = np.zeros(len(keys), bool)
        for level, own in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            pairs.append((owner[hit], own[at[hit]]))
            known |= hit
        keys, owner = keys[~known], owner[~known]
        if len(keys):
            self.levels.append((keys, owner))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, own = np.concatenate([b, a]), np.concatenate([y, x])
            order = np.argsort(both, kind="stable")  # a merge: both are sorted
            self.levels.append((both[order], own[order]))
            self.merges += 1
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([*x, none]) for x in zip(*pairs, strict=True)) if pairs else (none, none)

    def forget(self, stays: np.ndarray) -> None:
        """Keep the owners that stay; they are numbered anew."""
        new = np.cumsum(stays) - 1
        self.levels = [(k[stays[o]], new[o[stays[o]]]) for k, o in self.levels if stays[o].any()]


class Columns:
    """Columns of rows that are appended; they grow by doubling."""

    def __init__(self, **kinds: object) -> None:
        self.n, self.data = 0, {k: np.zeros((0, *shape), t) for k, (t, *shape) in kinds.items()}

    def add(self, **cols: np.ndarray) -> np.ndarray:
        """The numbers of the new rows."""
        size = len(next(iter(cols.values())))
        for k, v in cols.items():
            have = self.data[k]
            if self.n + size > len(have):
                more = np.zeros((max(1024, 2 * len(have), self.n + size), *have.shape[1:]), have.dtype)
                more[: self.n] = have[: self.n]
                have = self.data[k] = more
            have[self.n : self.n + size] = v
        self.n += size
        return np.arange(self.n - size, self.n)

    def __getitem__(self, k: str) -> np.ndarray:
        return self.data[k][: self.n]

    def forget(self, stays: np.ndarray) -> None:
        self.data = {k: v[: self.n][stays] for k, v in self.data.items()}
        self.n = int(stays.sum())


def pieces(group: np.ndarray, text: list[bytes], place: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, shift, key, ends) of the parts of segments in which STEP places agree on all but their ends, of all batches alike.

    place: of the core in the text; a hot row's text is one such part already. shift: of the
    part's first byte in the text; ends: its first and last STEP bytes. The strings of a part
    are shift .. shift + STEP, those that the text holds."""
    pad = STEP
    data = np.frombuffer(b"".join(bytes(pad) + t + bytes(pad) for t in text), np.uint8)
    size = np.array([len(t) + 2 * pad for t in text])
    off = np.r_[0, np.cumsum(size)]
    rows, shifts = [], []
    plain = np.flatnonzero(~hot)
    for j in range(REACH // STEP):
        r = plain
        shift = place[r] - REACH + j * STEP  # of the first string of the part; negative: before the text
        lo = shift + STEP  # what all of its strings share
        hi = shift + LENGTH
        ok = (lo >= 0) & (hi <= size[r] - 2 * pad)
        rows.append(r[ok])
        shifts.append(shift[ok])
    rows.append(np.flatnonzero(hot))
    shifts.append(place[hot])
    row, shift = np.concatenate(rows), np.concatenate(shifts)
    at = off[row] + pad + shift
    shared = C.string_hashes(data, at + STEP, at + LENGTH)
    key = C.mix(shared + group[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(hot[row], 0, shift - place[row]).astype(np.uint64))
    ends = np.concatenate([data[at[:, None] + np.arange(STEP)], data[at[:, None] + LENGTH + np.arange(STEP)]], axis=1) if len(at) else np.zeros((0, 2 * STEP), np.uint8)
    return row, shift, key, ends


def suffixes(key: np.ndarray, place: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Truncated suffixes of parts: key, place, and the bytes that aren't shared; a last byte of 1 guards trailing zeros."""
    out = np.ones((len(key), STEP + 10), np.uint8)
    out[:, :8] = key.astype(">u8").view(np.uint8).reshape(len(key), 8)
    out[:, 8] = place
    out[:, 9:-1] = ends[np.arange(len(key))[:, None], place[:, None] + np.arange(STEP)]
    return out.view(f"S{STEP + 10}").ravel()


class Scan:
    """Compares segments that arrive in batches, those of a group one behind the other."""

    def __init__(self, limit: int = HELD) -> None:
        self.parts, self.suffixes, self.limit = Family(), Family(), limit
        #: lo, hi: which places of a part the text holds; done: its suffixes are in their levels
        self.rows = Columns(group=(np.int64,), number=(np.int64,), s=(np.int64,), lo=(np.int8,), hi=(np.int8,), single=(bool,), done=(bool,), key=(np.uint64,), ends=(np.uint8, 2 * STEP))
        self.strings = Columns(part=(np.int64,), place=(np.int8,), told=(bool,))

    def feed(self, group: np.ndarray, text: list[bytes], place: np.ndarray, hot: np.ndarray, start: np.ndarray, number: np.ndarray, single: np.ndarray) -> Iterator[pa.RecordBatch]:
        """start: the text's own place in its document. Yields (number, s, e): strings [s, e) that occur again."""
        if self.rows.n + self.strings.n > self.limit:
            self._forget(group[0])
        row, shift, key, ends = pieces(group, text, place, hot)
        size = np.array([len(t) for t in text])[row]
        lo, hi = np.maximum(0, -shift), np.minimum(STEP, size - LENGTH - shift)
        some = lo <= hi
        row, shift, key, ends, lo, hi = (x[some] for x in (row, shift, key, ends, lo, hi))
        mine = self.rows.add(group=group[row], number=number[row], s=start[row] + shift, lo=lo, hi=hi, single=single[row], done=np.zeros(len(row), bool), key=key, ends=ends)
        again = np.unique(np.concatenate(self.parts.add(key, mine)))
        again = again[~self.rows["done"][again]]
        self.rows["done"][again] = True
        # every place of the parts that agree with others
        lo, hi = self.rows["lo"][again].astype(int), self.rows["hi"][again].astype(int)
        part = np.repeat(np.arange(len(again)), hi - lo + 1)
        at = lo[part] + np.arange(len(part)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
        own = self.strings.add(part=again[part], place=at, told=np.zeros(len(part), bool))
        found = np.unique(np.concatenate(self.suffixes.add(suffixes(self.rows["key"][again][part], at, self.rows["ends"][again][part]), own)))
        found = found[~self.strings["told"][found]]
        self.strings["told"][found] = True
        p = self.strings["part"][found]
        keep = self.rows["single"][p]
        a, s = self.rows["number"][p[keep]], self.rows["s"][p[keep]] + self.strings["place"][found[keep]]
        if len(a):
            order = np.lexsort((s, a))
            a, s = a[order], s[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (s[1:] > s[:-1] + LENGTH)]
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]
            yield C.batch({"number": a[new], "s": s[new], "e": s[last] + LENGTH})

    def _forget(self, group: int) -> None:
        """Drop what belongs to groups that have ended; one that goes on is kept, however large."""
        stays = self.rows["group"] == group
        strings = stays[self.strings["part"]]
        new = np.cumsum(stays) - 1
        self.parts.forget(stays)
        self.suffixes.forget(strings)
        self.rows.forget(stays)
        self.strings.forget(strings)
        self.strings["part"][:] = new[self.strings["part"]]
        self.limit = max(HELD, 2 * (self.rows.n + self.strings.n))


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2 of every row; k1, k2, copies, body of every distinct text, bodies compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, off, data in C.runs(b.column(1), 4 << 20):
                raw = [data[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
                keys = np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=16).digest() for r in raw), np.int64).reshape(-1, 2)
                yield C.batch({
                    "doc_id": b.column(0).slice(lo, hi - lo), "k1": keys[:, 0], "k2": keys[:, 1], "size": np.diff(off),
                    "body": pa.array([pa.compress(r, codec="zstd", asbytes=True) for r in raw], pa.binary()),
                })

    all_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, k1 long, k2 long, size long, body binary")
    return all_.select("doc_id", "k1", "k2"), all_.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("size").alias("size"), F.first("body").alias("body"))


def _bodies(body: pa.Array, size: pa.Array, limit: int = C.RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of compressed texts, as common.runs()."""
    sizes, i = size.to_numpy(), 0
    while i < len(sizes):
        j, total = i, 0
        while j < len(sizes) and (j == i or total + sizes[j] <= limit):
            total += int(sizes[j])
            j += 1
        raw = [pa.decompress(x.as_buffer(), int(n), codec="zstd", asbytes=True) if n else b"" for x, n in zip(body.slice(i, j - i), sizes[i:j], strict=True)]
        yield i, j, np.r_[0, np.cumsum(sizes[i:j])], np.frombuffer(b"".join(raw), np.uint8)
        i = j


def repeats(texts: DataFrame) -> DataFrame:
    """number, spans (array of s, e; they may overlap) of the texts with strings that occur in other distinct texts or twice in one."""

    def print_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, off, data in _bodies(b.column(2), b.column(1)):
                text, place, core, seg = anchors(off, data)
                number = b.column(0).to_numpy()[lo + text]
                yield C.batch({"core": core.view(np.int64), "seg": seg.view(np.int64), "number": number, "at": (place - off[text]).astype(np.int32), "size": np.diff(off)[text].astype(np.int32)})

    own = texts.where(f"size >= {LENGTH}").select("number", "size", "body")
    prints = own.mapInArrow(print_, "core long, seg long, number long, at int, size int")
    classes = C.store(prints.groupBy("core", "seg").agg(F.count("*").alias("n"), F.min(F.struct("number", "at")).alias("one")))
    groups = classes.groupBy("core").agg(F.count("*").alias("segs"), F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1")
    whole = prints.join(classes.where("n > 1").select("core", "seg"), ["core", "seg"], "left_semi").select(
        "number", F.greatest(F.col("at") - REACH, F.lit(0)).cast("long").alias("s"), F.least(F.col("at") + LENGTH, F.col("size")).cast("long").alias("e")
    )
    # at most SHARES cores have so many segments that the join would send them to one task; these few are broadcast
    many = max(HOT, int(classes.count() / SHARES))
    groups = C.cut(groups.where("segs > 1 AND least = 1").select("core", "segs"))
    crowded = F.broadcast(groups.where(F.col("segs") > many))
    unlike = classes.join(crowded, "core").unionByName(classes.join(crowded.select("core"), "core", "left_anti").join(groups.where(F.col("segs") <= many), "core")).select("core", "n", "segs", "one.*")
    wanted = unlike.groupBy("number").agg(F.collect_list(F.struct("core", "at", (F.col("segs") > HOT).alias("hot"), (F.col("n") == 1).alias("single"))).alias("want"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, off, data in _bodies(b.column(2), b.column(1)):
                rows = {k: [] for k in ("group", "text", "place", "hot", "start", "number", "single")}
                for i in range(lo, hi):
                    raw = data[off[i - lo] : off[i - lo + 1]].tobytes()
                    number = b.column(0)[i].as_py()
                    for w in b.column(3)[i].as_py():
                        a, z = max(0, w["at"] - REACH), min(len(raw), w["at"] + LENGTH)
                        parts = [(w["core"], a, z, w["at"] - a)]
                        if w["hot"]:
                            parts = []
                            for j in range(REACH // STEP):
                                s = w["at"] - REACH + j * STEP
                                if s + STEP >= 0 and s + LENGTH <= len(raw):
                                    digest = hashlib.blake2b(raw[s + STEP : s + LENGTH], digest_size=8, key=f"{w['core']}:{j}".encode()).digest()
                                    x = max(0, s)
                                    parts.append((int.from_bytes(digest, "little", signed=True), x, min(len(raw), s + LENGTH + STEP), s - x))
                        for group, x, y, place in parts:
                            for name, v in zip(rows, (group, raw[x:y], place, w["hot"], x, number, w["single"]), strict=True):
                                rows[name].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("group", pa.int64()), ("text", pa.binary()), ("place", pa.int32()), ("hot", pa.bool_()), ("start", pa.int32()), ("number", pa.int64()), ("single", pa.bool_())]))

    segments = own.join(wanted, "number").mapInArrow(cut, "group long, text binary, place int, hot boolean, start int, number long, single boolean")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan()
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                p = b.slice(lo, BATCH)
                col = {n: p.column(p.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("group", "place", "hot", "start", "number", "single")}
                text = p.column(p.schema.get_field_index("text")).to_pylist()
                yield from scan.feed(col["group"], text, col["place"].astype(np.int64), col["hot"].astype(bool), col["start"].astype(np.int64), col["number"], col["single"].astype(bool))
        C.trim()

    found = segments.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "number long, s long, e long")
    return whole.unionByName(found).groupBy("number").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether bytes go) of every row; with full also kept, the bytes that remain.

    Null and empty texts have no bytes; texts under LENGTH bytes have no match;
    rows with null or repeated ids are treated by their texts. Every occurrence of
    a repeated string goes, the first one too. Further columns aren't read.
    """
    C.ready(docs.sparkSession)
    rows, texts = distinct_texts(docs, id_col, text_col)
    texts = C.store(texts.withColumn("number", F.monotonically_increasing_id()))
    spans = repeats(texts)
    schema = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, off, data in _bodies(b.column(4), b.column(3)):
                out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
                for i in range(lo, hi):
                    raw = data[off[i - lo] : off[i - lo + 1]]
                    gone = np.zeros(len(raw) + 1, np.int64)
                    if b.column(2)[i].as_py() > 1 and len(raw) >= LENGTH:
                        gone[0] = 1
                    elif spans := b.column(5)[i].as_py():
                        for x in spans:
                            gone[x["s"]] += 1
                            gone[x["e"]] -= 1
                    mask = np.cumsum(gone)[:-1] > 0
                    left = raw[~mask].tobytes()
                    out["n_bytes"].append(len(raw))
                    out["n_removed"].append(int(mask.sum()))
                    out["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                    out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                    out["kept"].append(left)
                cols = {"k1": b.column(0).slice(lo, hi - lo), "k2": b.column(1).slice(lo, hi - lo)} | {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.binary() if k == "kept" else pa.int64()) for k, v in out.items() if full or k != "kept"}
                yield C.batch(cols)

    done = texts.join(spans, "number", "left").select("k1", "k2", "copies", "size", "body", "spans").mapInArrow(run, schema)
    return rows.join(done, ["k1", "k2"]).drop("k1", "k2").withColumn("repeats", F.col("n_removed") > 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(C.table(spark, sf_dir, "documents"))
