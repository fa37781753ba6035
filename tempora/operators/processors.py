"""Stateful signal operators, composed of nodes; see plans/nodes.py."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions import levels as L
from tempora.plans import nodes as N
from tempora.plans.timeline import Signal, Timeline, _if, _tuple


def _when(at: Column, x: Column) -> Column:
    return F.when(at, x)


def _py_when(at: bool, x: Any) -> Any:
    return x if at else None


def _or_else(x: Column, default: Column) -> Column:
    return F.coalesce(x, default)


def _py_or_else(x: Any, default: Any) -> Any:
    return default if x is None else x


def _choose(c: bool, a: Any, b: Any) -> Any:
    return a if c else b


def _hold(at: Signal, x: Signal, default: Any, *run: Signal) -> Signal:
    return Signal(at.line, N.Hold((at.node, x.node, *(r.node for r in run)), default), default)


def _total(x: Signal, how: str = "sum", *run: Signal) -> Signal:
    return Signal(x.line, N.Total((x.node, *(r.node for r in run)), how=how), None)


def _filled(x: Signal, default: Any) -> Signal:
    return x.with_(_or_else, default, default=default, py=_py_or_else, total=True) if default is not None else x


def _as(s: Signal, default: Any) -> Signal:
    """s, whose type has another default."""
    return Signal(s.line, s.node, default)


def timed(s: Signal, *timers: N.Timer) -> Signal:
    """s, with moments of its own."""
    return Signal(s.line, replace(s.node, timers=(*s.node.timers, *timers)), s.default)


def accumulate(control: Signal, data: Signal, init: Any = 0, only: Callable[[Any], Any] | None = None) -> Signal:
    """init plus data at each change of control to a value that passes only."""
    at = control.changes()
    if only is not None:
        at = at & control.map(only, False)
    return _as(_filled(_total(at.with_(_when, data, py=_py_when)), 0) + init, init)


def edge_latch(control: Signal, data: Signal, forget: int | str = -1) -> Signal:
    """data where control last changed; with a duration, back to the default when it has passed."""
    ttl, at = L.duration(forget), control.changes()
    held = _hold(at, data, data.default)
    if ttl < 0:
        return held
    since = _hold(at, control.line.now(), -(1 << 62))
    kept = control.line.now() < since + ttl
    return timed(if_(kept, held, Signal(control.line, N.Const(value=data.default), data.default)), N.Timer(at.node, ttl))


def level_latch(control: Signal, data: Signal, forget: int | str = -1, kind: str = "int") -> Signal:
    """data while control is true, then held; with a duration, until it has passed since the last moment, of any
    operator, at which control was true. That depends on all moments, so it runs as a fold; kind is its type."""
    ttl = L.duration(forget)
    if ttl < 0:
        return _hold(control, data, data.default)
    return Signal(control.line, N.LevelLatch((control.node, data.node), data.default, ttl=ttl, kind=kind), data.default)


def been_true(control: Signal, within: int | str = -1) -> Signal:
    """Whether control is true, or was: ever, or until less than the duration ago."""
    ttl = L.duration(within)
    if ttl < 0:
        return _as(_filled(_total(control, "max"), False), False)
    ended = ~control & Signal(control.line, N.Prev((control.node,), False), False)
    since = _hold(ended, control.line.now(), -(1 << 62))
    return timed(control | (control.line.now() < since + ttl), N.Timer(ended.node, ttl))


def duration_of_previous_level(s: Signal) -> Signal:
    """The length of the level that ended last; the first is counted from time 0."""
    at, now = s.changes(), s.line.now()
    started = _hold(at, now, 0)
    before = Signal(s.line, N.Prev((started.node,), 0), 0)
    return _hold(at, now - before, 0)


def scope_run(scope: Signal) -> Signal:
    """A number that grows with each change of scope."""
    return _total(scope.changes().cast("int"))


def state_fold(name: str, data: Signal, clock: Signal, scope: Signal | None = None, init: Any = None) -> Signal:
    """SUM, MIN, MAX, AND or OR of data at the ticks of clock, begun anew in each scope."""
    base = {"SUM": 0, "AND": True, "OR": False}.get(name) if init is None else init
    how = {"SUM": "sum", "MIN": "min", "MAX": "max", "AND": "min", "OR": "max"}[name]
    total = _total(clock.changes().with_(_when, data, py=_py_when), how, *([scope_run(scope)] if scope is not None else []))
    if base is None:
        return _as(_filled(total, data.default), data.default)
    join, py = {"SUM": (operator.add, None), "MIN": (_least, min), "MAX": (_greatest, max), "AND": (operator.and_, None), "OR": (operator.or_, None)}[name]
    return _filled(total, 0 if name == "SUM" else base).with_(join, base, default=data.default, py=py, total=True)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _greatest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


class StateMachineBuilder:
    """A state that f(state, data) replaces at each tick of clock; with a scope, begun anew at each of its changes.

    build() takes any f and runs as a fold. saturating() and time_domain folds are machines that windows can tell."""

    def __init__(self, clock: Signal, data: Signal) -> None:
        self.clock, self.data = clock, data
        self.init: Any = 0
        self.f: Callable[[Any, Any], Any] | None = None
        self.scope: Signal | None = None

    def init_state(self, init: Any) -> StateMachineBuilder:
        self.init = init
        return self

    def transition_fn(self, f: Callable[[Any, Any], Any]) -> StateMachineBuilder:
        self.f = f
        return self

    def scoped(self, scope: Signal) -> StateMachineBuilder:
        self.scope = scope
        return self

    def build(self, kind: str = "int", default: Any = None) -> Signal:
        if self.f is None:
            raise ValueError("no transition function")
        inputs = [self.clock.changes().node, self.data.node] + ([self.scope.changes().node] if self.scope is not None else [])
        default = {"string": "", "boolean": False, "double": 0.0}.get(kind, 0) if default is None else default
        return Signal(self.clock.line, N.StateMachine(tuple(inputs), default, f=self.f, init=self.init, kind=kind), default)

    def finite(self, states: Sequence[Any], alphabet: Sequence[Any], longest: int = 1 << 16) -> Signal:
        """The machine of these states (init among them) over this data, as windows: a moment is a map of states, and maps are
        composed by doubling, in as many windows as the logarithm of longest, the most moments that an entity may have (more
        are an error). Other data leave the state as it is."""
        if self.f is None:
            raise ValueError("no transition function")
        same, start = list(range(len(states))), list(states).index(self.init)
        maps = {a: [list(states).index(self.f(s, a)) for s in states] for a in alphabet}

        def column(at: Column, data: Column, *reset: Column) -> Column:
            out = F.array(*map(F.lit, same))
            for a, m in maps.items():
                out = F.when(at & (data == a), F.array(*map(F.lit, m))).otherwise(out)
            return F.when(reset[0], F.array_repeat(F.element_at(out, start + 1), len(same))).otherwise(out) if reset else out

        def plain(at: bool, data: Any, *reset: bool) -> list[int]:
            out = maps.get(data, same) if at else same
            return [out[start]] * len(same) if reset and reset[0] else out

        at = self.clock.changes()
        out = at.with_(column, self.data, *([self.scope.changes()] if self.scope is not None else []), py=plain, total=True)
        for k in range(max(1, (longest - 1).bit_length())):
            out = Signal(out.line, N.Doubled((out.node,), None, reach=1 << k), None)
        place = _total(at.line.const(1), "count")
        default = type(self.init)()

        def state(maps: Column, n: Column) -> Column:
            own = F.element_at(F.array(*map(F.lit, states)), F.element_at(maps, start + 1) + 1)
            return F.when(n <= longest, own).otherwise(F.raise_error(F.lit(f"an entity of more than {longest} moments")))

        return out.with_(state, place, default=default, py=lambda m, n: states[m[start]], total=True)

    def saturating(self, limit: int) -> Signal:
        """The machine that counts ticks from init up to limit."""
        ticks = _total(self.clock.changes().with_(_when, 1, py=_py_when), "count", *([scope_run(self.scope)] if self.scope is not None else []))
        return (ticks + self.init).with_(_least, limit, default=0, py=min, total=True)


def prior_value(s: Signal, clock: Signal, scope: Signal | None = None) -> Signal:
    """The value at the tick of clock before the last one, within a scope."""
    at, run = clock.changes(), [scope_run(scope)] if scope is not None else []
    ticked = Signal(s.line, N.Before((at.node, s.node, *(r.node for r in run))), None)
    return _hold(at, _filled(ticked, s.default), s.default, *run)


def sliding_window(trigger: Signal, data: Signal, n: int, emit: Callable[[Any, Any], Any], init: Any, default: Any, py: Callable[[list, Any], Any] | None = None) -> Signal:
    """emit(last n triggered inputs, the one evicted last or init) at each trigger, held between."""
    at = trigger.changes()
    queue = Signal(data.line, N.Recent((at.node, data.node), n=n), None)
    gone = Signal(data.line, N.Evicted((at.node, data.node), n=n, init=init), None)
    return _hold(at, queue.with_(emit, gone, py=py and _guarded(py)), default)


def _guarded(f: Callable[..., Any]) -> Callable[..., Any]:
    return lambda queue, gone: None if queue is None else f(queue, gone)


def moving_average(s: Signal, n: int) -> Signal:
    """The mean of the last n levels; NaN before the first change."""
    at = s.changes()
    return _hold(at, Signal(s.line, N.Recent((at.node, s.node), n=n, mean=True), None), float("nan"))


def sliding_time_window(trigger: Signal, data: Signal, span: int | str, emit: Callable[[Any, Any], Any] | str, init: Any, default: Any, py: Callable[[list, Any], Any] | None = None) -> Signal:
    """emit(inputs triggered less than span ago, the one evicted last or init), also at the moments when one goes.

    emit may name a summary of the inputs (count, sum, min, max, mean), which needs no list of them."""
    size, at = L.duration(span), trigger.changes()
    inputs, timer = (at.node, data.node), N.Timer(at.node, size)
    if isinstance(emit, str):
        return timed(_as(_filled(Signal(data.line, N.Within(inputs, span=size, how=emit), None), default), default), timer)
    queue = Signal(data.line, N.Within(inputs, span=size), None)
    gone = Signal(data.line, N.Expired(inputs, span=size, init=init), None)
    return timed(queue.with_(emit, gone, default=default, py=py), timer)


def liveness(clock: Signal, is_live: Column, timeout: int | str = "90s", py: Callable[[dict], bool] | None = None) -> Signal:
    """Whether a later event that is live, told by its own fields, comes before timeout has passed since the last tick of clock."""
    limit, line = L.duration(timeout), clock.line
    ticked = _hold(clock.changes(), line.now(), 0)
    return line.next_event(is_live, py, limit) < ticked + limit


def generator(line: Timeline, f: Callable[[Any, int], tuple[Any, Any, int]], init: Any, kind: str, default: Any = 0) -> Signal:
    """A source driven by time alone: f(state, ts) -> (state, value, duration until it is asked again)."""
    return Signal(line, N.Generator((), default, f=f, init=init, kind=kind), default)


def square_wave(line: Timeline, period: int | str, phase: int | str = 0) -> Signal:
    """True in every second period."""
    p, q = L.duration(period), L.duration(phase)
    wave = line.now().with_(lambda t: F.pmod(_div(t - q, p), F.lit(2)) == 1, default=False, py=lambda t: (t - q) // p % 2 == 1, total=True)
    return timed(wave, N.Timer(period=p, phase=q % p))


def monotonic_steps(line: Timeline, start: int, step: int, period: int | str, phase: int | str = 0) -> Signal:
    """start, and step more for each boundary passed since the entity's first moment."""
    p, q = L.duration(period), L.duration(phase)
    first = _hold(Signal(line, N.First(), False), line.now(), 0)
    # the first boundary that counts is the one that follows the first moment's own multiple of the period
    passed = line.now().with_(lambda t, f: F.greatest(F.lit(0), _div(t - q, p) - _div(f, p)), first, default=0, py=lambda t, f: max(0, (t - q) // p - f // p), total=True)
    return timed(_as(passed * step + start, 0), N.Timer(period=p, phase=q % p))


def _div(x: Column, p: int) -> Column:
    """Floored division of whole numbers, without doubles."""
    return F.call_function("div", x - F.pmod(x, F.lit(p)), F.lit(p))


def if_(c: Signal, a: Signal, b: Signal) -> Signal:
    return c.with_(_if, a, b, default=a.default, py=_choose, total=True)


def cond(first: tuple[Signal, Signal], middle: Sequence[tuple[Signal, Signal]], fallback: Signal) -> Signal:
    """The middle branches are tried in order, the first branch after them, as the fallback's nearest."""
    out = if_(first[0], first[1], fallback)
    for c, v in reversed(middle):
        out = if_(c, v, out)
    return out


def make_tuple(*s: Signal) -> Signal:
    return s[0].with_(_tuple, *s[1:], default=tuple(x.default for x in s), py=lambda *v: v, total=True)


class FilterBuilder:
    """A signal or its clock, let through while all predicates hold."""

    def __init__(self, signal: Signal, clock: Signal | None = None) -> None:
        self.signal = signal
        self.clock = clock if clock is not None else signal.clock()
        self.tests: list[Signal] = []

    def filter_fn(self, f: Callable[[Any], Any], py: Callable[[Any], bool] | None = None) -> FilterBuilder:
        self.tests.append(self.signal.map(f, False, py))
        return self

    def filter_values(self, *values: Any) -> FilterBuilder:
        self.tests.append(self.signal.with_(lambda c: c.isin(*values), default=False, py=lambda v: v in values, total=True))
        return self

    def filter_true(self) -> FilterBuilder:
        self.tests.append(self.signal)
        return self

    def then_filter(self, signal: Signal) -> FilterBuilder:
        """Filter another signal on the ticks that this one lets through; a boolean one for true."""
        nxt = FilterBuilder(signal, self.build_clock_filter())
        return nxt.filter_true() if signal.default is False else nxt

    def _control(self) -> Signal:
        if not self.tests:
            raise ValueError("nothing to filter by")
        out = self.tests[0]
        for t in self.tests[1:]:
            out = out & t
        return out

    def build_clock_filter(self) -> Signal:
        return level_latch(self._control(), self.clock)

    def build_value_filter(self) -> Signal:
        return level_latch(self._control(), self.signal)


def session_ids(clock: Signal, gap: int | str) -> tuple[Signal, Signal]:
    """(alive, id): alive for gap after each tick; the id counts both edges, so sessions are odd and gaps even."""
    alive = clock.has_changed(gap)
    return alive, alive.count_changes()


def sessionized(line: Timeline, field: str, session: Signal, default: Any = None) -> Signal:
    """A field's level if it was assigned in this session, else its default."""
    level, clock = line.signal(field), line.signal(f"{field}__clock")
    return sessionized_by(level, edge_latch(session, line.now()), edge_latch(clock, line.now()), default)


def sessionized_by(level: Signal, began: Signal, assigned: Signal, default: Any = None) -> Signal:
    """level where it was assigned no earlier, by an epoch of one's own, than the session began."""
    default = level.default if default is None else default
    return if_(began <= assigned, level, Signal(level.line, N.Const(value=default), level.default))
