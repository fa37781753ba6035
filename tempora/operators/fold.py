"""A query as a fold over each entity's moments: what windows can't express, and streams.

Machine runs all nodes of a query at every moment of one entity, the engine's own
moments included, just as they come due; its state is small and can be kept. In
batch an entity's events stream through it in order, so a task holds one batch of
rows at a time however long an entity is.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from tempora.functions import levels as L
from tempora.plans import nodes as N

if TYPE_CHECKING:
    from tempora.plans.policy import Query
    from tempora.plans.timeline import Field

CHUNK = 4096


@dataclass
class State:
    """All that a machine knows of an entity."""

    levels: dict[str, Any]
    nodes: list[Any]
    ahead: dict[str, int] = field(default_factory=dict)
    queue: list[int] = field(default_factory=list)
    due: dict[int, bool] = field(default_factory=dict)  # times in the queue: whether to measure then
    first: int | None = None
    before: dict[str, Any] | None = None  # the row let out last


def _portable(n: N.Node) -> N.Node:
    """The node as a fold needs it, without columns."""
    if isinstance(n, N.Next):
        return N.Base(name=n.name)
    if isinstance(n, N.Apply) and n.py is not None:
        return replace(n, f=n.py, py=None)
    return n


class Machine:
    def __init__(self, query: Query) -> None:
        roots = query.roots()
        nodes, number = N.canonical(list(roots.values()))
        self.fields: dict[str, Field] = query.line.fields
        self.inputs = [[number[id(x)] for x in n.inputs] for n in nodes]
        self.timers = [(number[id(t.at)], t.offset) for n in nodes for t in n.timers if t.at is not None]
        self.timers = sorted(set(self.timers))
        self.regular = sorted({(t.period, t.phase, False) for n in nodes for t in n.timers if t.at is None} | {(p, 0, True) for p in query.periods})
        self.next = {n.name: n for n in nodes if isinstance(n, N.Next)}
        self.look_ahead = max([n.ahead for n in nodes], default=0)
        self.next_py = {k: n.py for k, n in self.next.items()}
        self.next = dict.fromkeys(self.next)
        self.nodes = [replace(_portable(n), inputs=(), timers=()) for n in nodes]
        self.roots = {k: number[id(r)] for k, r in roots.items()}
        self.at_events, self.gates = query.at_events, len(query.gate)
        self.metrics = [(n, interval) for n, (_, _, interval) in query.metrics.items()]

    def new(self) -> State:
        clocks = {f"{n}__clock": 0 for n in self.fields}
        return State({n: f.initial for n, f in self.fields.items()} | clocks | {"_clock": 0}, [n.start() for n in self.nodes])

    def _schedule(self, s: State, at: int, measure: bool = False) -> None:
        if at not in s.due:
            heapq.heappush(s.queue, at)
        s.due[at] = s.due.get(at, False) or measure

    def _moment(self, s: State, ts: int, external: bool, measure: bool) -> tuple[int, dict[str, Any]] | None:
        moment = N.Moment(ts, s.levels, s.ahead, external, lambda at: self._schedule(s, at))
        got: list[Any] = []
        for i, n in enumerate(self.nodes):
            s.nodes[i], v = n.step(s.nodes[i], moment, *[got[j] for j in self.inputs[i]])
            got.append(v)
        for at, offset in self.timers:
            if got[at]:
                self._schedule(s, ts + offset)
        for period, phase, m in self.regular:
            origin = s.first if m else phase
            self._schedule(s, ts - (ts - origin) % period + period, m)
        r = self.roots
        when = measure or (self.at_events and external and ("filter" not in r or got[r["filter"]])) or ("trigger" in r and got[r["trigger"]])
        if not when or not all(got[r[f"gate{i}"]] for i in range(self.gates)):
            return None
        row = {n: got[r[f"m_{n}"]] for n, _ in self.metrics}
        out: dict[str, Any] = {}
        reset = got[r["reset"]] if "reset" in r else None
        for n, interval in self.metrics:
            out[n] = row[n]
            if interval:
                kept = s.before is not None and (s.before[n] is None or s.before["_reset"] == reset)
                out[interval] = row[n] - ((s.before[n] or 0) if kept else 0)
        s.before = row | {"_reset": reset}
        return ts, out

    def idle(self, s: State, until: int) -> Iterator[tuple[int, dict[str, Any]]]:
        """The engine's own moments before until."""
        while s.queue and s.queue[0] < until:
            at = heapq.heappop(s.queue)
            if (got := self._moment(s, at, False, s.due.pop(at))) is not None:
                yield got

    def feed(self, s: State, ts: int, patches: list[dict[str, Any]], ahead: dict[str, int]) -> Iterator[tuple[int, dict[str, Any]]]:
        """Rows (ts, metrics) let out up to the moment that the patches, of one time, make."""
        if s.first is None:
            s.first = ts
        yield from self.idle(s, ts)
        measure = s.due.pop(ts, False)
        if s.queue and s.queue[0] == ts:
            heapq.heappop(s.queue)
        v = s.levels
        for p in patches:
            v["_clock"] += 1
            for n, f in self.fields.items():
                x = p.get(n)
                if f.volatile or x is not None:
                    v[n] = f.initial if x is None else x
                    v[f"{n}__clock"] += 1
        s.ahead = ahead
        if (got := self._moment(s, ts, True, measure)) is not None:
            yield got


def run(query: Query, key: str, ts: str | None, carried: dict[str, str]) -> DataFrame:
    """The batch form; see Query.run()."""
    machine, line = Machine(query), query.line
    schema = query.schema(key, ts, carried)
    arrow = to_arrow_schema(schema)
    merge, extras = line.merge, [f"_c_{c}" for c in carried]
    rows = line.rows.withColumns(line._next(N.ordered(list(query.roots().values()))))
    rows = (line.spread(rows) or rows.repartition(L.KEY)).sortWithinPartitions(L.KEY, L.TS, L.SEQ)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state, group, last = None, [], None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        def close() -> None:
            k, at = last
            for when, got in machine.feed(state, at, group, {n: group[-1][n] for n in machine.next}):
                tail = [group[-1][c] if when == at else None for c in extras]
                out.append((k, *([when] if ts else []), *tail, *got.values()))
            group.clear()

        for b in batches:
            names = b.schema.names
            for lo in range(0, b.num_rows, CHUNK):
                for values in zip(*(c.to_pylist() for c in b.slice(lo, CHUNK).columns), strict=True):
                    row = dict(zip(names, values, strict=True))
                    now = (row[L.KEY], row[L.TS])
                    if group and (now != last or not merge):
                        close()
                    if state is None or now[0] != last[0]:
                        state = machine.new()
                    group.append(row)
                    last = now
                if out:
                    yield batch()
        if group:
            close()
        yield batch()

    return rows.mapInArrow(step, schema)


def timed_nodes(query: Query, rows: list[dict[str, Any]]) -> dict[str, float]:
    """Seconds that each node takes over some patches of one entity (dicts with "ts"): where a fold spends its time."""
    machine = Machine(query)
    took = [0.0] * len(machine.nodes)

    class Watched:
        def __init__(self, i: int, node: N.Node) -> None:
            self.i, self.node = i, node

        def start(self) -> Any:
            return self.node.start()

        def step(self, *args: Any) -> Any:
            t = time.perf_counter()
            try:
                return self.node.step(*args)
            finally:
                took[self.i] += time.perf_counter() - t

    machine.nodes = [Watched(i, n) for i, n in enumerate(machine.nodes)]  # type: ignore[misc]
    state = machine.new()
    for r in rows:
        list(machine.feed(state, r["ts"], [r], dict.fromkeys(machine.next, N.NEVER)))
    return {f"{i} {type(w.node).__name__}": s for i, (w, s) in enumerate(zip(machine.nodes, took, strict=True))}
