"""Timelines: the moments of every entity, and the signals on them.

A Timeline holds sparse events (null: not assigned). Signals on it only tell what to
compute; nothing is planned before a Query runs. Then operators with timers insert
moments of their own, layer by layer, and only when all moments are there are levels
derived, so the order in which signals, measurements and timers are declared doesn't
matter. Nodes are computed by depth: what needs no other window first, in one
selection for each depth, all windows over one exchange and one order.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import levels as L
from tempora.plans import nodes as N
from tempora.plans.split import Splitter

MEASURE, LAST, FIRST = "_measure", "_last", "_first"
#: Rows that one task sorts, about. Spark's own number of tasks follows bytes as shuffled, far fewer than a window's sort holds.
SHARE = 200_000


@dataclass(frozen=True)
class Field:
    """An input field. A volatile one falls back to its default whenever an event doesn't assign it,
    and its clock ticks with every event. An enumeration's values are ranked as declared."""

    type: str
    default: Any = None
    volatile: bool = False
    source: str | None = None
    values: tuple[str, ...] = ()

    @property
    def initial(self) -> Any:
        if self.default is not None:
            return self.default
        if self.values:
            return self.values[0]
        if self.type.startswith("array"):
            return []
        return {"string": "", "boolean": False, "double": 0.0, "float": 0.0, "timestamp": datetime.fromtimestamp(0, UTC)}.get(self.type, 0)


def _tuple(*cols: Any) -> Any:
    return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(cols)])


def _if(c: Column, a: Column, b: Column) -> Column:
    return F.when(c, a).otherwise(b)


def _not(a: Column) -> Column:
    return ~a


class Signal:
    """A level at every moment. Comparisons and arithmetic give signals; truth does not exist."""

    def __init__(self, line: Timeline, node: N.Node, default: Any) -> None:
        self.line, self.node, self.default = line, node, default

    def __bool__(self) -> bool:
        raise TypeError("a signal has no single truth value; write (a > 0) & (a < 9)")

    __hash__ = object.__hash__

    def with_(self, f: Callable[..., Any], *others: Any, default: Any = None, py: Callable[..., Any] | None = None, total: bool = False) -> Signal:
        """f of self and others (signals or literals), given as columns; py: the same of plain values, where f can't do both."""
        inputs = tuple(o.node if isinstance(o, Signal) else N.Const(value=o) for o in (self, *others))
        return Signal(self.line, N.Apply(inputs, default, f=f, py=py, total=total), default)

    def __eq__(self, o: Any) -> Signal:  # type: ignore[override]
        return self.with_(operator.eq, o, default=False, total=True)

    def __ne__(self, o: Any) -> Signal:  # type: ignore[override]
        return self.with_(operator.ne, o, default=False, total=True)

    def __lt__(self, o: Any) -> Signal:
        return self.with_(operator.lt, o, default=False, total=True)

    def __le__(self, o: Any) -> Signal:
        return self.with_(operator.le, o, default=False, total=True)

    def __gt__(self, o: Any) -> Signal:
        return self.with_(operator.gt, o, default=False, total=True)

    def __ge__(self, o: Any) -> Signal:
        return self.with_(operator.ge, o, default=False, total=True)

    def __and__(self, o: Any) -> Signal:
        return self.with_(operator.and_, o, default=False, total=True)

    def __or__(self, o: Any) -> Signal:
        return self.with_(operator.or_, o, default=False, total=True)

    def __xor__(self, o: Any) -> Signal:
        return self.with_(operator.ne, o, default=False, total=True)

    def __invert__(self) -> Signal:
        return self.with_(_not, default=False, py=operator.not_, total=True)

    def __add__(self, o: Any) -> Signal:
        return self.with_(operator.add, o, default=self.default, total=True)

    def __sub__(self, o: Any) -> Signal:
        return self.with_(operator.sub, o, default=self.default, total=True)

    def __mul__(self, o: Any) -> Signal:
        return self.with_(operator.mul, o, default=self.default, total=True)

    def __truediv__(self, o: Any) -> Signal:
        return self.with_(operator.truediv, o, default=0.0)

    def map(self, f: Callable[[Column], Column], default: Any, py: Callable[[Any], Any] | None = None) -> Signal:
        """f of the column, a pandas UDF if need be; py: the same of a plain value, for folds, where f can't do both."""
        return self.with_(f, default=default, py=py)

    def cast(self, kind: str, default: Any = 0) -> Signal:
        convert = {"double": float, "float": float, "string": str, "boolean": bool}.get(kind, int)
        return self.with_(lambda c: c.cast(kind), default=default, py=convert)

    def parse(self, kind: str, default: Any = 0) -> Signal:
        return self.with_(lambda c: L.parse(c, kind, default), default=default, py=lambda v: L.parsed(v, kind, default), total=True)

    def starts_with(self, text: str) -> Signal:
        return self.with_(lambda c: c.startswith(text), default=False, py=lambda v: v.startswith(text), total=True)

    def timestamp(self) -> Signal:
        """A time's seconds since 1970."""
        return self.with_(F.unix_seconds, default=0, py=lambda v: int(v.timestamp()))

    def rank(self) -> Signal:
        """The ordinal of an enumeration's value."""
        values = self.line.fields[self.field].values
        return self.with_(lambda c: F.array_position(F.array(*map(F.lit, values)), c).cast("int") - 1, default=0, py=values.index, total=True)

    @property
    def field(self) -> str | None:
        return self.node.name if type(self.node) is N.Base and self.node.name in self.line.fields else None

    def clock(self) -> Signal:
        """The companion clock of an input field."""
        if self.field is None:
            raise ValueError("only an input field has a clock")
        return self.line.signal(f"{self.field}__clock")

    def changes(self) -> Signal:
        """Whether self differs from the moment before; at first, from the type's default."""
        return Signal(self.line, N.Changed((self.node,), False, against=self.default), False)

    def before(self) -> Signal:
        return Signal(self.line, N.Prev((self.node,), self.default), self.default)

    # sugar over the operators
    def count_changes(self) -> Signal:
        from tempora.operators import processors as P

        return P.accumulate(self, self.line.const(1))

    def has_been_true(self, within: int | str = -1) -> Signal:
        """Whether self was true before or, with a duration, is true or was within it (level_latch has the moment-grid variant)."""
        from tempora.operators import processors as P

        return P.been_true(self, within)

    def has_changed(self, within: int | str = -1) -> Signal:
        from tempora.operators import processors as P

        return P.edge_latch(self, self.line.const(True), within)

    def moving_average(self, n: int) -> Signal:
        from tempora.operators import processors as P

        return P.moving_average(self, n)

    def prior_value(self, clock: Signal, scope: Signal | None = None) -> Signal:
        from tempora.operators import processors as P

        return P.prior_value(self, clock, scope)

    def prior_different_value(self, scope: Signal | None = None) -> Signal:
        return self.prior_value(self, scope)


class Timeline:
    def __init__(self, rows: DataFrame, fields: dict[str, Field], merge: bool, carried: Sequence[str], split: int | None = None) -> None:
        self.rows, self.fields, self.merge, self.carried, self.split = rows, fields, merge, list(carried), split
        self._ahead, self._splitter, self._parts = 0, None, None

    @classmethod
    def of(cls, events: DataFrame, key: str, ts: str, seq: Sequence[str], fields: dict[str, Field], merge: bool = True, carried: Sequence[str] = (), split: int | None = None) -> Timeline:
        """fields name the columns of events (those without a time are left out, those without a key are one entity's);
        merge: events of one time make one moment; split: rows of an entity that
        a task takes at most, about, before the entity is split by time (see split.py)."""
        order = F.struct(*seq) if len(seq) > 1 else F.col(seq[0])
        time = F.col(ts) if dict(events.dtypes)[ts] == "bigint" else L.nanos(F.col(ts))

        def patch(n: str, f: Field) -> Column:
            x = F.col(f"`{f.source or n}`").cast(f.type)
            return F.when(x.isin(*f.values), x) if f.values else x

        rows = events.select(F.col(key).alias(L.KEY), time.alias(L.TS), order.alias(L.SEQ), F.lit(True).alias(L.EXT), *[patch(n, f).alias(n) for n, f in fields.items()], *[F.col(c).alias(f"_c_{c}") for c in carried])
        rows = rows.where(F.col(L.TS).isNotNull())
        return cls(rows, fields, merge, [f"_c_{c}" for c in carried], split)

    def signal(self, name: str) -> Signal:
        if name in self.fields:
            initial = self.fields[name].initial
        elif name == "_clock" or name.removesuffix("__clock") in self.fields:
            initial = 0
        else:
            raise KeyError(name)
        return Signal(self, N.Base(default=initial, name=name), initial)

    __getitem__ = signal

    def event_clock(self) -> Signal:
        return self.signal("_clock")

    def now(self) -> Signal:
        return Signal(self, N.Now(), 0)

    def const(self, value: Any) -> Signal:
        return Signal(self, N.Const(value=value), {str: "", bool: False, float: 0.0}.get(type(value), 0))

    def next_event(self, live: Column, py: Callable[[dict], bool] | None = None, span: int = 0) -> Signal:
        """The time of the next event that is live, told by its own fields (null: not assigned)."""
        self._ahead += 1
        return Signal(self, N.Next(name=f"_next{self._ahead}", live=live, py=py, span=span), 0)

    def window(self, f: Callable[..., Column], *inputs: Signal, default: Any = None, py: Callable[..., tuple[Any, Any]] | None = None, init: Any = None) -> Signal:
        """A signal by a window expression of one's own: f(window of the moments so far, the inputs' columns)."""
        return Signal(self, N.Windowed(tuple(i.node for i in inputs), default, f=f, py=py, init=init), default)

    def custom(self, f: Callable[..., tuple], *inputs: Signal, init: Any, kind: str, default: Any = None) -> Signal:
        """A signal by a fold of one's own: f(state, ts, *inputs) -> (state, value), or with a duration until the next moment."""
        return Signal(self, N.Custom(tuple(i.node for i in inputs), default, f=f, init=init, kind=kind), default)

    # lowering

    def measured(self) -> None:
        """Count the rows, if there is an end of them, so that spread() bounds those of a task."""
        if self._parts is None and not self.rows.isStreaming:
            self._parts = -(-self.rows.count() // SHARE)

    def spread(self, df: DataFrame, *by: str) -> DataFrame | None:
        """df by key (and more columns) in partitions of SHARE rows or so, entities whole; None if it is one task's or wasn't measured."""
        n = self._parts or 0
        if n <= 1:
            return None
        return df.repartition(max(n, min(df.sparkSession.sparkContext.defaultParallelism, 4 * n)), L.KEY, *by)

    def _next(self, nodes: list[N.Node]) -> dict[str, Column]:
        after = L.moments().rowsBetween(1, Window.unboundedFollowing)
        return {n.name: F.coalesce(F.min(F.when(n.live, F.col(L.TS))).over(after), F.lit(N.NEVER)) for n in nodes if isinstance(n, N.Next)}

    def levels(self, nodes: list[N.Node]) -> tuple[DataFrame, list[str]]:
        """(the events' moments with levels and clocks, names of these)."""
        new = self._next(nodes)
        new["_clock"] = F.count(F.lit(1)).over(L.so_far())
        for n, f in self.fields.items():
            x = F.col(f"`{n}`")
            new[n] = F.coalesce(x, F.lit(f.initial)) if f.volatile else L.held(x, f.initial)
            new[f"{n}__clock"] = F.count(F.lit(1)).over(L.so_far()) if f.volatile else L.clock(x)
        new[L.FOLLOW] = F.lead(L.TS).over(L.moments())
        df = (self.spread(self.rows) or self.rows).withColumns(new)
        if self.merge:
            df = df.where(F.col(L.FOLLOW).isNull() | (F.col(L.FOLLOW) != F.col(L.TS)))
        names = [n for n in new if n != L.FOLLOW]
        return df.select(L.KEY, L.TS, L.SEQ, L.EXT, L.FOLLOW, *[f"`{n}`" for n in names], *self.carried), names

    def columns(self, df: DataFrame, roots: list[N.Node], extra: dict[str, Column] | None = None) -> tuple[DataFrame, list[Column]]:
        """df with the windowed nodes that roots need, and the roots' columns; extra columns are added with the first windows."""
        nodes, number = N.canonical(roots)
        cols: list[Column] = []
        depth: list[int] = []
        layers: dict[int, dict[str, Column]] = {1: dict(extra or {})}
        read = N.read_by_windows(nodes, number)
        for i, n in enumerate(nodes):
            own = [number[id(x)] for x in n.inputs]
            expr = n.lower(*[cols[j] for j in own])
            d = max([depth[j] for j in own], default=0)
            if n.windowed:
                d = len(nodes) + 1 if n.run and i not in read else d + 1  # windows in runs at last, lest the others sort again
                layers.setdefault(d, {})[f"_n{i}"] = expr
                expr = F.col(f"_n{i}")
            cols.append(expr)
            depth.append(d)
        for d in sorted(layers):
            if layers[d]:
                df = df.withColumns(layers[d])
        return df, [cols[number[id(r)]] for r in roots]

    def exploded(self, df: DataFrame, names: list[str], timers: list[N.Timer], at: list[Column]) -> tuple[DataFrame, bool]:
        """(df's rows and those of the timers' moments, without levels and with MEASURE; whether any is to be measured).

        df tells LAST (the entity's last event) and FIRST. Regular moments are told by the row before them, so no row
        carries more than lie in one gap between events."""
        ts, long = F.col(L.TS), "bigint"
        told = iter(at)
        plain: list[Column] = []
        measured: list[Column] = []
        for t in timers:
            if t.at is not None:
                due = ts + F.lit(t.offset)
                plain.append(F.when(next(told) & (due < F.col(LAST)), F.array(due)))
                continue
            origin = F.col(FIRST) if t.measure else F.lit(t.phase).cast(long)
            step = F.lit(t.period).cast(long)
            due = ts - F.pmod(ts - origin, step) + step
            end = F.col(L.FOLLOW) if t.measure else F.col(L.FOLLOW) - 1
            (measured if t.measure else plain).append(F.when(due <= end, F.sequence(due, end, step)))
        none = F.array().cast("array<bigint>")
        kept = MEASURE in df.columns
        times = [F.transform(F.coalesce(x, none), lambda t: F.struct(t.alias("t"), F.lit(False).alias("m"))) for x in plain]
        times += [F.transform(F.coalesce(x, none), lambda t: F.struct(t.alias("t"), F.lit(True).alias("m"))) for x in measured]
        own = F.array(F.struct(F.lit(None).cast(long).alias("t"), (F.col(MEASURE) if kept else F.lit(False)).alias("m")))
        rows = df.select(L.KEY, L.TS, L.SEQ, L.EXT, *[f"`{n}`" for n in names], *self.carried, F.explode(F.concat(own, *times)).alias("_x"))
        given = F.col("_x.t").isNull()
        rows = rows.select(
            L.KEY, F.coalesce("_x.t", L.TS).alias(L.TS), F.when(given, F.col(L.SEQ)).alias(L.SEQ), (given & F.col(L.EXT)).alias(L.EXT), F.col("_x.m").alias(MEASURE),
            *[F.when(given, F.col(f"`{n}`")).alias(n) for n in (*names, *self.carried)],
        )
        return rows, bool(measured) or kept

    def insert(self, df: DataFrame, names: list[str], timers: list[N.Timer]) -> DataFrame:
        """df with the moments of the timers, before the entity's last event; one that coincides with another is dropped."""
        whole = L.moments().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        extra: dict[str, Column] = {}
        if any(t.at is not None for t in timers):
            extra[LAST] = F.max(F.when(F.col(L.EXT), F.col(L.TS))).over(whole)
        if any(t.measure for t in timers):
            extra[FIRST] = F.first(L.TS).over(L.so_far())
        df, at = self.columns(df, [t.at for t in timers if t.at is not None], extra)
        rows, measured = self.exploded(df, names, timers, at)
        filled = {n: F.last(f"`{n}`", ignorenulls=True).over(L.so_far()) for n in names}
        filled[L.FOLLOW] = F.lead(L.TS).over(L.moments())
        if measured:  # the time is measured even where another moment stands
            filled[MEASURE] = F.coalesce(F.last(F.when(F.col(MEASURE), F.col(L.TS)), ignorenulls=True).over(L.so_far()) == F.col(L.TS), F.lit(False))
        rows = rows.withColumns(filled).where(F.col(L.EXT) | F.col(L.FOLLOW).isNull() | (F.col(L.FOLLOW) != F.col(L.TS)))
        return rows if measured else rows.drop(MEASURE)

    def lower(self, roots: list[N.Node], every: Sequence[N.Timer] = ()) -> tuple[DataFrame, list[Column]]:
        """(all moments, the roots' columns)."""
        nodes, number = N.canonical(roots)
        how = self.splitter() or self
        df, names = how.levels(nodes)
        layer: list[int] = []
        due: dict[int, dict[tuple, N.Timer]] = {}
        for n in nodes:
            own = max([layer[number[id(x)]] for x in n.inputs], default=0)
            for t in n.timers:
                at = layer[number[id(t.at)]] if t.at is not None else 0
                mark = (number[id(t.at)] if t.at is not None else None, t.offset, t.period, t.phase)
                due.setdefault(at, {})[mark] = t
                own = max(own, at + 1)
            layer.append(own)
        for t in every:
            due.setdefault(0, {})[None, 0, t.period, -1] = t
        for k in sorted(due):
            df = how.insert(df, names, list(due[k].values()))
        return how.columns(df, roots)

    def splitter(self) -> Splitter | None:
        """What lowers a timeline whose large entities are split, if there are any."""
        if self.split and self._splitter is None:
            self._splitter = Splitter(self, self.split)
        return self._splitter if self._splitter is not None and self._splitter.cuts is not None else None

    def previous(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        """df with _b_<name> for each of cols: the value in the entity's row before, wrapped; null at the first."""
        if (how := self.splitter()) is not None:
            return how.previous(df, cols)
        return df.withColumns({f"_b_{c}": F.lag(F.struct(F.col(c).alias("v"))).over(L.moments()) for c in cols}) if cols else df
