"""The nodes that signals are made of. Each is told twice: as a column of a moment frame, and
as a step of a fold over one entity's moments.

lower() gives the column from the inputs' columns. A node that is windowed becomes a column
of its own, all others stay expressions. step() gives (new state, value) from the state
and the inputs' values at one moment; it is what folds and streams run, and what windows are
held against in tests. A node whose class sets folded has no window form.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from types import FunctionType
from typing import Any

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tempora.functions import levels as L


@dataclass(frozen=True)
class Timer:
    """Moments of the engine's own: offset after each moment at which `at` is true, at the multiples of
    period plus phase, or (measure) at the multiples of period since the entity's first event."""

    at: Node | None = None
    offset: int = 0
    period: int = 0
    phase: int = 0
    measure: bool = False


@dataclass(frozen=True, eq=False)
class Node:
    inputs: tuple[Node, ...] = ()
    default: Any = None
    timers: tuple[Timer, ...] = ()

    windowed = False
    folded = False
    nullable = False
    run = False  # whether its window begins anew with each value of its last input, which takes a sort of its own
    ahead = 0  # how far the node looks into the future, in ns

    def key(self) -> tuple:
        """Nodes of equal keys are one column."""
        own = tuple((n, _hashable(v)) for n, v in vars(self).items() if n not in ("inputs", "timers", "py"))
        return (type(self).__name__, own)

    def lower(self, *cols: Column) -> Column:
        raise NotImplementedError

    def start(self) -> Any:
        return None

    def step(self, state: Any, moment: Moment, *values: Any) -> tuple[Any, Any]:
        raise NotImplementedError


def _hashable(v: Any) -> Any:
    return (type(v).__name__, repr(v)) if isinstance(v, (int, str, float, bool, tuple, type(None))) else id(v)


def _text(f: Any, seen: tuple = ()) -> Any:
    """What tells a pure function from others: its text and what it holds. A lambda is made anew at each call of what is around it."""
    if not isinstance(f, FunctionType) or id(f) in seen:
        return _hashable(f)
    try:
        held = [c.cell_contents for c in f.__closure__ or ()]
    except ValueError:  # a name that isn't set yet
        return id(f)
    return (f.__code__, id(f.__globals__), *(_text(x, (*seen, id(f))) for x in (*held, *(f.__defaults__ or ()), *(f.__kwdefaults__ or {}).values())))


@dataclass
class Moment:
    """What a fold knows at a moment."""

    ts: int
    levels: dict[str, Any]
    ahead: dict[str, int]
    external: bool = True
    schedule: Callable[[int], None] = lambda at: None


lit = L.lit
#: The time of an event that never comes.
NEVER = 2**63 - 1


# Sources


@dataclass(frozen=True, eq=False)
class Base(Node):
    """A column that the frame has from the start: a field's level, a clock, an event that lies ahead."""

    name: str = ""

    def lower(self) -> Column:
        return F.col(f"`{self.name}`")

    def step(self, state, moment):
        return None, moment.levels[self.name] if self.name in moment.levels else moment.ahead[self.name]


@dataclass(frozen=True, eq=False)
class Next(Base):
    """The time of the next event that is live, a column over the event's own fields; py tells of a dict of them."""

    live: Any = None
    py: Callable[[dict], bool] | None = None
    span: int = 0

    @property
    def ahead(self) -> int:  # type: ignore[override]
        return self.span


@dataclass(frozen=True, eq=False)
class Now(Node):
    def lower(self) -> Column:
        return F.col(L.TS)

    def step(self, state, moment):
        return None, moment.ts


@dataclass(frozen=True, eq=False)
class Const(Node):
    value: Any = None

    @property
    def nullable(self) -> bool:  # type: ignore[override]
        return self.value is None

    def lower(self) -> Column:
        return lit(self.value)

    def step(self, state, moment):
        return None, self.value


@dataclass(frozen=True, eq=False)
class First(Node):
    """Whether this is the entity's first moment."""

    windowed = True

    def lower(self) -> Column:
        return F.lag(F.lit(1)).over(L.moments()).isNull()

    def start(self):
        return True

    def step(self, state, moment):
        return False, state


# Expressions


@dataclass(frozen=True, eq=False)
class Apply(Node):
    """f of the inputs. py does the same to plain values; without it f is used for both."""

    f: Callable[..., Any] = None  # type: ignore[assignment]
    py: Callable[..., Any] | None = None
    total: bool = False  # never null unless an input is

    def key(self) -> tuple:
        return (type(self).__name__, _text(self.f), _hashable(self.default), self.total)

    @property
    def nullable(self) -> bool:  # type: ignore[override]
        return not self.total or any(i.nullable for i in self.inputs)

    def lower(self, *cols: Column) -> Column:
        return self.f(*cols)

    def step(self, state, moment, *values):
        return None, (self.py or self.f)(*values)


# Windows over the moments before


@dataclass(frozen=True, eq=False)
class Prev(Node):
    """The level at the moment before, at first the default."""

    windowed = True

    @property
    def nullable(self) -> bool:  # type: ignore[override]
        return self.default is None or self.inputs[0].nullable

    def lower(self, x: Column) -> Column:
        return L.prev(x, self.default)

    def start(self):
        return self.default

    def step(self, state, moment, x):
        return x, state


@dataclass(frozen=True, eq=False)
class Changed(Node):
    """Whether the level differs from that of the moment before, which at first is the type's default."""

    windowed = True
    against: Any = None

    def lower(self, x: Column) -> Column:
        return L.changed(x, self.against)

    def start(self):
        return self.against

    def step(self, state, moment, x):
        return x, x != state


def _span(run: list[Column]) -> WindowSpec:
    return Window.partitionBy(L.KEY, *run).orderBy(L.TS, L.SEQ).rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True, eq=False)
class Hold(Node):
    """The value (second input) where the first input last was true; a third input, a run, forgets it when it changes."""

    windowed = True

    @property
    def run(self) -> bool:  # type: ignore[override]
        return len(self.inputs) == 3

    @property
    def nullable(self) -> bool:  # type: ignore[override]
        return self.default is None or self.inputs[1].nullable

    def lower(self, at: Column, x: Column, *run: Column) -> Column:
        if not self.inputs[1].nullable:
            last = F.last(F.when(at, x), ignorenulls=True).over(_span(list(run)))
            return last if self.default is None else F.coalesce(last, lit(self.default))
        last = F.last(F.when(at, F.struct(x.alias("v"))), ignorenulls=True).over(_span(list(run)))
        return last["v"] if self.default is None else F.when(last.isNull(), lit(self.default)).otherwise(last["v"])

    def start(self):
        return (None, self.default)

    def step(self, state, moment, at, x, *run):
        kept = self.default if run and state[0] != run[0] else state[1]
        kept = x if at else kept
        return (run[0] if run else None, kept), kept


@dataclass(frozen=True, eq=False)
class Before(Node):
    """The value where the first input was true last before this moment, within a run."""

    windowed = True
    nullable = True

    @property
    def run(self) -> bool:  # type: ignore[override]
        return len(self.inputs) == 3

    def lower(self, at: Column, x: Column, *run: Column) -> Column:
        return F.last(F.when(at, x), ignorenulls=True).over(_span(list(run)).rowsBetween(Window.unboundedPreceding, -1))

    def start(self):
        return (None, None)

    def step(self, state, moment, at, x, *run):
        kept = None if run and state[0] != run[0] else state[1]
        return (run[0] if run else None, x if at else kept), kept


_COMBINE = {"sum": lambda a, b: a + b, "min": min, "max": max, "count": lambda a, b: a + b}


@dataclass(frozen=True, eq=False)
class Total(Node):
    """sum, min, max or count of the inputs that aren't null, so far, within a run."""

    windowed = True
    nullable = True
    how: str = "sum"

    @property
    def run(self) -> bool:  # type: ignore[override]
        return len(self.inputs) == 2

    def lower(self, x: Column, *run: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[self.how](x).over(_span(list(run)))

    def start(self):
        return (None, None)

    def step(self, state, moment, x, *run):
        kept = None if run and state[0] != run[0] else state[1]
        if self.how == "count":
            kept = (kept or 0) + (x is not None)
        elif x is not None:
            kept = x if kept is None else _COMBINE[self.how](kept, x)
        return (run[0] if run else None, kept), kept


@dataclass(frozen=True, eq=False)
class Integral(Node):
    """The input times the nanoseconds that it held, so far; of a boolean, how long it was true. The frame tells the moment after each."""

    windowed = True

    def lower(self, x: Column) -> Column:
        span = F.col(L.FOLLOW) - F.col(L.TS)
        part = F.when(x, span) if self.default == 0 and not isinstance(self.default, float) else x.cast("double") * span
        return F.coalesce(F.sum(part).over(L.so_far().rowsBetween(Window.unboundedPreceding, -1)), lit(self.default))

    def start(self):
        return (self.default, None, None)

    def step(self, state, moment, x):
        total, ts, before = state
        if ts is not None and before:
            total += before * (moment.ts - ts)
        return (total, moment.ts, x), total


def _ticks(at: Column) -> WindowSpec:
    return Window.partitionBy(L.KEY, at.cast("int")).orderBy(L.TS, L.SEQ)


@dataclass(frozen=True, eq=False)
class Recent(Node):
    """At the moments at which the first input is true, the last n of the second (agg: their mean), else null."""

    windowed = True
    nullable = True
    n: int = 1
    mean: bool = False

    def lower(self, at: Column, x: Column) -> Column:
        w = _ticks(at).rowsBetween(-(self.n - 1), 0)
        return F.when(at, F.avg(x.cast("double")).over(w) if self.mean else F.collect_list(x).over(w))

    def start(self):
        return deque(maxlen=self.n)

    def step(self, state, moment, at, x):
        if not at:
            return state, None
        state.append(x)
        return state, sum(state) / len(state) if self.mean else list(state)


@dataclass(frozen=True, eq=False)
class Evicted(Node):
    """At the moments at which the first input is true, the second of n such moments ago, else null."""

    windowed = True
    nullable = True
    n: int = 1
    init: Any = None

    def lower(self, at: Column, x: Column) -> Column:
        return F.when(at, F.coalesce(F.lag(x, self.n).over(_ticks(at)), lit(self.init)))

    def start(self):
        return deque(maxlen=self.n + 1)

    def step(self, state, moment, at, x):
        if not at:
            return state, None
        state.append(x)
        return state, state[0] if len(state) > self.n else self.init


_SUMMARY = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "list": F.collect_list}
_PY_SUMMARY = {
    "count": len, "sum": lambda v: sum(v) if v else None, "min": lambda v: min(v, default=None), "max": lambda v: max(v, default=None),
    "mean": lambda v: sum(v) / len(v) if v else None, "list": list,
}


@dataclass(frozen=True, eq=False)
class Within(Node):
    """A summary of the second input at the moments less than span ago at which the first was true."""

    windowed = True
    nullable = True
    span: int = 0
    how: str = "list"

    def lower(self, at: Column, x: Column) -> Column:
        return _SUMMARY[self.how](F.when(at, x)).over(Window.partitionBy(L.KEY).orderBy(L.TS).rangeBetween(-(self.span - 1), 0))

    def start(self):
        return deque()

    def step(self, state, moment, at, x):
        while state and state[0][0] <= moment.ts - self.span:
            state.popleft()
        if at:
            state.append((moment.ts, x))
        return state, _PY_SUMMARY[self.how]([v for _, v in state])


@dataclass(frozen=True, eq=False)
class Expired(Node):
    """The second input at the last moment span ago or more at which the first was true."""

    windowed = True
    nullable = True
    span: int = 0
    init: Any = None

    def lower(self, at: Column, x: Column) -> Column:
        return F.coalesce(F.last(F.when(at, x), ignorenulls=True).over(Window.partitionBy(L.KEY).orderBy(L.TS).rangeBetween(Window.unboundedPreceding, -self.span)), lit(self.init))

    def start(self):
        return (deque(), self.init)

    def step(self, state, moment, at, x):
        queue, gone = state
        while queue and queue[0][0] <= moment.ts - self.span:
            gone = queue.popleft()[1]
        if at:
            queue.append((moment.ts, x))
        return (queue, gone), gone


@dataclass(frozen=True, eq=False)
class Windowed(Node):
    """A user's own window expression: f(window so far, input columns), and py(state, values) -> (state, value) for folds."""

    windowed = True
    nullable = True
    f: Callable[..., Column] = None  # type: ignore[assignment]
    py: Callable[..., tuple[Any, Any]] | None = None
    init: Any = None

    def lower(self, *cols: Column) -> Column:
        return self.f(L.so_far(), *cols)

    def start(self):
        return self.init

    def step(self, state, moment, *values):
        if self.py is None:
            raise TypeError("a window expression without its own step runs in batch only")
        return self.py(state, *values)


@dataclass(frozen=True, eq=False)
class Doubled(Node):
    """Maps of numbers, given as arrays: each after what the moments from twice as far back, up to reach moments ago, come to."""

    windowed = True
    reach: int = 1

    def lower(self, x: Column) -> Column:
        earlier = F.lag(x, self.reach).over(L.moments())
        return F.when(earlier.isNull(), x).otherwise(F.transform(earlier, lambda s: F.element_at(x, s + 1)))

    def start(self):
        return deque(maxlen=self.reach)

    def step(self, state, moment, x):
        out = [x[s] for s in state[0]] if len(state) == self.reach else x
        state.append(x)
        return state, out


# Folds: nothing but a step


@dataclass(frozen=True, eq=False)
class Folded(Node):
    kind: str = "int"
    folded = True
    windowed = True
    nullable = True

    def lower(self, *cols: Column) -> Column:
        """The type only; such nodes never run as windows."""
        return F.lit(None).cast(self.kind)


@dataclass(frozen=True, eq=False)
class StateMachine(Folded):
    """State f(state, data) where the trigger (first input, a change) is; where a third input changes, init comes first."""

    f: Callable[[Any, Any], Any] = None  # type: ignore[assignment]
    init: Any = None

    def start(self):
        return self.init

    def step(self, state, moment, at, data, *reset):
        state = self.init if reset and reset[0] else state
        state = self.f(state, data) if at else state
        return state, state


@dataclass(frozen=True, eq=False)
class LevelLatch(Folded):
    """The level latch with a duration: its timer is armed anew at every moment at which the control is true,
    whosever moment it is."""

    ttl: int = 0

    def start(self):
        return (self.default, None)

    def step(self, state, moment, control, data):
        value, until = state
        if control:
            value, until = data, moment.ts + self.ttl
            moment.schedule(until)
        elif until is not None and moment.ts >= until:
            value, until = self.default, None
        return (value, until), value


@dataclass(frozen=True, eq=False)
class Generator(Folded):
    """A source driven by time: f(state, ts) -> (state, value, duration until it is asked again)."""

    f: Callable[[Any, int], tuple[Any, Any, int]] = None  # type: ignore[assignment]
    init: Any = None

    def start(self):
        return (self.init, self.default, 0)

    def step(self, state, moment):
        own, value, until = state
        if until <= moment.ts:
            own, value, more = self.f(own, moment.ts)
            until = moment.ts + more
            if more > 0:
                moment.schedule(until)
        return (own, value, until), value


@dataclass(frozen=True, eq=False)
class Custom(Folded):
    """A user's own operator: f(state, ts, *inputs) -> (state, value) or (state, value, duration until it wants a moment)."""

    f: Callable[..., tuple] = None  # type: ignore[assignment]
    init: Any = None

    def start(self):
        return self.init

    def step(self, state, moment, *values):
        state, value, *more = self.f(state, moment.ts, *values)
        if more and more[0]:
            moment.schedule(moment.ts + more[0])
        return state, value


def ordered(roots: list[Node]) -> list[Node]:
    """All nodes that roots need, inputs first, timers' nodes too; nodes of equal keys once (see canonical())."""
    seen: dict[int, Node] = {}

    def visit(n: Node) -> None:
        stack = [(n, False)]
        while stack:
            x, done = stack.pop()
            if id(x) in seen:
                continue
            if done:
                seen[id(x)] = x
                continue
            stack.append((x, True))
            stack += [(i, False) for i in (*x.inputs, *(t.at for t in x.timers if t.at is not None))]

    for r in roots:
        visit(r)
    return list(seen.values())


def canonical(roots: list[Node]) -> tuple[list[Node], dict[int, int]]:
    """(distinct nodes, inputs first; the number in it of each node by id). Equal nodes of equal inputs are one."""
    found: dict[tuple, int] = {}
    nodes: list[Node] = []
    number: dict[int, int] = {}
    for n in ordered(roots):
        timers = tuple((number[id(t.at)] if t.at is not None else None, t.offset, t.period, t.phase, t.measure) for t in n.timers)
        k = (n.key(), tuple(number[id(i)] for i in n.inputs), timers)
        if k not in found:
            found[k] = len(nodes)
            nodes.append(n)
        number[id(n)] = found[k]
    return nodes, number


def read_by_windows(nodes: list[Node], number: dict[int, int]) -> set[int]:
    """The numbers of the nodes (as canonical() gives them) that a window needs."""
    out: set[int] = set()
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].windowed or i in out:
            out.update(number[id(x)] for x in nodes[i].inputs)
    return out
