"""Timelines whose large entities are split by time.

Windows need an entity's moments in one task. Here an entity with more than its share of
rows is cut at quantiles of its times. Every window is computed within a chunk; what it
needs of the chunks before it (the last level, a total so far) is one small row a
chunk, which is summed up along the entity and joined to the chunk's rows. That is
done depth by depth, and what a depth has computed is stored, so that it is computed
once. Entities of ordinary size stay whole. The results are those of the unsplit form. Operators that need several earlier
values at once (sliding windows, windows of one's own) aren't split.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import levels as L
from tempora.plans import nodes as N

if TYPE_CHECKING:
    from tempora.plans.timeline import Timeline

CHUNK, CUTS = "_chunk", "_cuts"
#: No chunk gets more than one row in SHARES, and no more entities than that are cut, so cuts are few enough to be broadcast.
SHARES = 1000


def stored(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared folder and read again."""
    sc = df.sparkSession.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="split")
    path = posixpath.join(top, f"split-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _within(*run: Column) -> Any:
    return Window.partitionBy(L.KEY, CHUNK, *run).orderBy(L.TS, L.SEQ)


def _upto(*run: Column) -> Any:
    return _within(*run).rowsBetween(Window.unboundedPreceding, 0)


def _along() -> Any:
    return Window.partitionBy(L.KEY).orderBy(CHUNK)


def _earlier() -> Any:
    return _along().rowsBetween(Window.unboundedPreceding, -1)


def _later() -> Any:
    return _along().rowsBetween(1, Window.unboundedFollowing)


def _everywhere() -> Any:
    return _along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


@dataclass
class Part:
    """A window over chunks: local within each, summary (an aggregate of a chunk's rows), carry (a window over the
    chunks' summaries, given as s), and both joined, given local and carry.

    told: a further local window, which summary reads as the column TOLD; late: what carry gives is for the next chunk."""

    local: Column
    summary: Column
    carry: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    told: Column | None = None
    late: bool = False


TOLD = "_told"


def _place() -> Column:
    return F.struct(L.TS, L.SEQ)


def _last_row(x: Column) -> Column:
    return F.max_by(F.struct(x.alias("v")), _place())


def _first_in_chunk() -> Column:
    return F.row_number().over(_within()) == 1


def latest(at: Column, x: Column, default: Any, before: bool = False) -> Part:
    """x where at last was true (before this moment)."""
    hit = F.when(at, F.struct(x.alias("v")))
    w = _within().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    summary = F.max_by(hit, F.when(at, _place()))

    def join(local: Column, carry: Column) -> Column:
        both = F.coalesce(local, carry)
        return both["v"] if default is None else F.when(both.isNull(), L.lit(default)).otherwise(both["v"])

    return Part(F.last(hit, ignorenulls=True).over(w), summary, lambda s: F.last(s, ignorenulls=True).over(_earlier()), join)


_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def _plus(how: str, a: Column, b: Column) -> Column:
    if how in ("sum", "count"):
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.least(a, b) if how == "min" else F.greatest(a, b)


def running(x: Column, how: str) -> Part:
    up = "sum" if how == "count" else how
    return Part(_AGG[how](x).over(_upto()), _AGG[how](x), lambda s: _AGG[up](s).over(_earlier()), lambda local, carry: _plus(how, local, carry))


def in_run(local: Column, full: Column, run: Column, up: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Part:
    """A window within runs: only a chunk's last run can go on in the next one. full: the window up to and with each row;
    up: how the values of a run's chunks are summed up."""
    summary = F.max_by(F.struct(run.alias("run"), F.col(TOLD).alias("x")), _place())

    def carry(s: Column) -> Column:
        along = Window.partitionBy(L.KEY, s["run"]).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0)
        return F.struct(s["run"].alias("run"), up(s["x"]).over(along).alias("x"))

    return Part(local, summary, carry, lambda mine, c: join(mine, F.when(c["run"].eqNullSafe(run), c["x"])), full, True)


def part_of(n: N.Node, cols: list[Column]) -> Part:
    """The split form of a windowed node, from its inputs' columns."""
    if isinstance(n, N.Prev):
        return Part(F.struct(F.lag(cols[0]).over(_within()).alias("v"), _first_in_chunk().alias("first")), _last_row(cols[0]), lambda s: F.lag(s).over(_along()), lambda a, c: _or(F.when(a["first"], c["v"]).otherwise(a["v"]), n.default))
    if isinstance(n, N.Changed):
        return Part(F.struct(F.lag(cols[0]).over(_within()).alias("v"), _first_in_chunk().alias("first")), _last_row(cols[0]), lambda s: F.lag(s).over(_along()), lambda a, c: ~cols[0].eqNullSafe(_or(F.when(a["first"], c["v"]).otherwise(a["v"]), n.against)))
    if isinstance(n, N.First):
        return Part(_first_in_chunk(), F.lit(1), lambda s: F.lag(s).over(_along()), lambda a, c: a & c.isNull())
    if isinstance(n, (N.Hold, N.Before)):
        before, default = isinstance(n, N.Before), n.default
        if len(cols) == 2:
            return latest(*cols, default, before)
        at, x, run = cols
        hit = F.when(at, F.struct(x.alias("v")))
        own = F.last(hit, ignorenulls=True)

        def join(local: Column, carry: Column) -> Column:
            both = F.coalesce(local, carry)
            return both["v"] if default is None else F.when(both.isNull(), L.lit(default)).otherwise(both["v"])

        full = own.over(_upto(run))
        local = own.over(_within(run).rowsBetween(Window.unboundedPreceding, -1)) if before else full
        return in_run(local, full, run, lambda v: F.last(v, ignorenulls=True), join)
    if isinstance(n, N.Total):
        if len(cols) == 1:
            return running(cols[0], n.how)
        x, run = cols
        up = _AGG["sum" if n.how == "count" else n.how]
        full = _AGG[n.how](x).over(_upto(run))
        return in_run(full, full, run, up, lambda a, c: _plus(n.how, a, c))
    if isinstance(n, N.Integral):
        span = F.col(L.FOLLOW) - F.col(L.TS)
        part = F.when(cols[0], span) if n.default == 0 and not isinstance(n.default, float) else cols[0].cast("double") * span
        own = F.sum(part).over(_within().rowsBetween(Window.unboundedPreceding, -1))
        return Part(own, F.sum(part), lambda s: F.sum(s).over(_earlier()), lambda a, c: F.coalesce(_plus("sum", a, c), L.lit(n.default)))
    raise ValueError(f"{type(n).__name__} needs several earlier values; its entities can't be split")


def _or(x: Column, default: Any) -> Column:
    return x if default is None else F.coalesce(x, L.lit(default))


def computed(line: Timeline, df: DataFrame, parts: dict[str, Part]) -> DataFrame:
    """df with a column for each part. Entities that aren't cut have the chunk -1 alone; only those that are have
    summaries, of SHARES chunks or so."""
    if not parts:
        return df
    names = {n: f"_p{i}" for i, n in enumerate(parts)}
    local = {f"{p}l": parts[n].local for n, p in names.items()} | {f"{p}t": parts[n].told for n, p in names.items() if parts[n].told is not None}
    given = [c for c in df.columns if c not in parts]
    df = stored((line.spread(df, CHUNK) or df).withColumns(local))
    cut = df.where(F.col(CHUNK) >= 0)
    plain = {p: parts[n].summary.alias(p) for n, p in names.items() if parts[n].told is None}
    summaries = cut.groupBy(L.KEY, CHUNK).agg(F.count(F.lit(1)).alias("_n"), *plain.values())
    for n, p in names.items():
        if parts[n].told is not None:
            own = cut.withColumn(TOLD, F.col(f"{p}t")).groupBy(F.col(L.KEY).alias("_k"), F.col(CHUNK).alias("_ch")).agg(parts[n].summary.alias(p))
            summaries = summaries.join(own, summaries[L.KEY].eqNullSafe(own["_k"]) & (summaries[CHUNK] == own["_ch"])).drop("_k", "_ch")
    for n, p in names.items():
        summaries = summaries.withColumn(p, parts[n].carry(F.col(p)))
        if parts[n].late:
            summaries = summaries.withColumn(p, F.lag(p).over(_along()))
    keys = stored(summaries.select(F.col(L.KEY).alias("_k"), F.col(CHUNK).alias("_ch"), *names.values()))
    both = df.join(F.broadcast(keys), df[L.KEY].eqNullSafe(F.col("_k")) & (df[CHUNK] == F.col("_ch")), "left")
    return both.select(*[F.col(f"`{c}`") for c in given], *[parts[n].join(F.col(f"{p}l"), F.col(p)).alias(n) for n, p in names.items()])


class Splitter:
    def __init__(self, line: Timeline, most: int) -> None:
        self.line = line
        sizes = stored(line.rows.groupBy(L.KEY).agg(F.count("*").alias("n")))
        total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        self.most = max(most, -(-total // SHARES), 1)
        pieces = -(-largest // self.most)
        shares = [i / pieces for i in range(1, pieces)]
        big = sizes.where(F.col("n") > self.most).select(F.col(L.KEY).alias("_k"))
        if shares:
            own = line.rows.select(L.KEY, L.TS)
            cuts = own.join(F.broadcast(big), own[L.KEY].eqNullSafe(F.col("_k"))).groupBy("_k").agg(F.array_distinct(F.percentile_approx(L.TS, shares, 10_000)).alias(CUTS))
            self.cuts = stored(cuts)
        else:
            self.cuts = None

    def chunked(self, df: DataFrame) -> DataFrame:
        """df with the number of the chunk of each row."""
        both = df.join(F.broadcast(self.cuts), df[L.KEY].eqNullSafe(F.col("_k")), "left")
        return both.withColumn(CHUNK, F.coalesce(F.size(F.filter(CUTS, lambda c: c < F.col(L.TS))), F.lit(-1))).drop("_k", CUTS)

    def follow(self) -> Part:
        return Part(F.lead(L.TS).over(_within()), F.min(L.TS), lambda s: F.lead(s).over(_along()), F.coalesce)

    def levels(self, nodes: list[N.Node]) -> tuple[DataFrame, list[str]]:
        line = self.line
        parts: dict[str, Part] = {}
        for n in nodes:
            if isinstance(n, N.Next):
                at = F.when(n.live, F.col(L.TS))
                after = _within().rowsBetween(1, Window.unboundedFollowing)
                parts[n.name] = Part(F.min(at).over(after), F.min(at), lambda s: F.min(s).over(_later()), lambda a, c: F.coalesce(F.least(a, c), F.lit(N.NEVER)))
        parts["_clock"] = running(F.lit(1), "count")
        volatile = {}
        for n, f in line.fields.items():
            x = F.col(f"`{n}`")
            if f.volatile:
                volatile[n] = F.coalesce(x, F.lit(f.initial))
            else:
                parts[n] = latest(x.isNotNull(), x, f.initial)
            parts[f"{n}__clock"] = running(F.lit(1) if f.volatile else x, "count")
        parts[L.FOLLOW] = self.follow()
        df = computed(line, self.chunked(line.rows), parts).withColumns(volatile)
        if line.merge:
            df = df.where(F.col(L.FOLLOW).isNull() | (F.col(L.FOLLOW) != F.col(L.TS)))
        names = [*[n for n in parts if n != L.FOLLOW], *volatile]
        return df.select(L.KEY, CHUNK, L.TS, L.SEQ, L.EXT, L.FOLLOW, *[f"`{n}`" for n in names], *line.carried), names

    def columns(self, df: DataFrame, roots: list[N.Node], extra: dict[str, Part] | None = None) -> tuple[DataFrame, list[Column]]:
        nodes, number = N.canonical(roots)
        cols: list[Column] = []
        depth: list[int] = []
        layers: dict[int, dict[str, Part]] = {1: dict(extra or {})}
        for i, n in enumerate(nodes):
            own = [number[id(x)] for x in n.inputs]
            d = max([depth[j] for j in own], default=0) + n.windowed
            if n.windowed:
                layers.setdefault(d, {})[f"_n{i}"] = part_of(n, [cols[j] for j in own])
                cols.append(F.col(f"_n{i}"))
            else:
                cols.append(n.lower(*[cols[j] for j in own]))
            depth.append(d)
        for d in sorted(layers):
            df = computed(self.line, df, layers[d])
        return df, [cols[number[id(r)]] for r in roots]

    def insert(self, df: DataFrame, names: list[str], timers: list[N.Timer]) -> DataFrame:
        from tempora.plans.timeline import FIRST, LAST, MEASURE

        ext = F.when(F.col(L.EXT), F.col(L.TS))
        all_ = _within().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        extra = {
            LAST: Part(F.max(ext).over(all_), F.max(ext), lambda s: F.max(s).over(_everywhere()), lambda a, c: F.coalesce(c, a)),
            FIRST: Part(F.min(L.TS).over(all_), F.min(L.TS), lambda s: F.min(s).over(_everywhere()), lambda a, c: F.coalesce(c, a)),
        }
        df, at = self.columns(df, [t.at for t in timers if t.at is not None], extra)
        rows, measured = self.line.exploded(df, names, timers, at)
        rows = self.chunked(rows)
        parts = {n: latest(F.col(L.EXT) | F.col(f"`{n}`").isNotNull(), F.col(f"`{n}`"), None) for n in names}
        parts[L.FOLLOW] = self.follow()
        if measured:
            parts[MEASURE] = latest(F.col(MEASURE), F.col(L.TS), -1)
        rows = computed(self.line, rows, parts)
        if measured:
            rows = rows.withColumn(MEASURE, F.col(MEASURE) == F.col(L.TS))
        rows = rows.where(F.col(L.EXT) | F.col(L.FOLLOW).isNull() | (F.col(L.FOLLOW) != F.col(L.TS)))
        return rows if measured else rows.drop(MEASURE)

    def previous(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        """df with _b_<name> for each of cols: the value in the row before, wrapped; null at an entity's first."""
        parts = {
            f"_b_{c}": Part(F.struct(F.lag(F.struct(F.col(c).alias("v"))).over(_within()).alias("v"), _first_in_chunk().alias("first")), _last_row(F.col(c)), lambda s: F.last(s, ignorenulls=True).over(_earlier()), lambda a, c_: F.when(a["first"], c_).otherwise(a["v"]))
            for c in cols
        }
        return computed(self.line, df, parts)
