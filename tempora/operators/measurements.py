"""Time-aware measurements, each at a moment (right) and just before its update (left)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.operators import processors as P
from tempora.plans import nodes as N
from tempora.plans.timeline import Signal, Timeline


@dataclass(frozen=True)
class Measure:
    right: Signal
    left: Signal

    def map(self, f: Callable[[Any], Any], py: Callable[[Any], Any] | None = None) -> Measure:
        return Measure(self.right.with_(f, default=0, py=py), self.left.with_(f, default=0, py=py))

    def combine(self, f: Callable[[Any, Any], Any], other: Measure, py: Callable[[Any, Any], Any] | None = None) -> Measure:
        return Measure(self.right.with_(f, other.right, default=0, py=py), self.left.with_(f, other.left, default=0, py=py))

    def scoped(self, scope: Signal) -> Measure:
        """Less what it was when scope last changed."""
        base = P._hold(scope.changes(), self.left, 0)
        before = Signal(base.line, N.Prev((base.node,), 0), 0)
        return Measure(self.right - base, self.left - before)


def _prev(s: Signal, default: Any) -> Signal:
    return Signal(s.line, N.Prev((s.node,), default), default)


def peek(s: Signal) -> Measure:
    return Measure(s, _prev(s, s.default))


def peek_timestamp(line: Timeline) -> Measure:
    return Measure(line.now(), line.now())


def formatted(m: Measure) -> Measure:
    """Nanoseconds as text in UTC, to milliseconds."""

    def text(t: Column) -> Column:
        return F.concat(F.date_format(F.timestamp_micros(F.call_function("div", t, F.lit(1000))), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC"))

    def plain(t: int) -> str:
        s, rest = divmod(t, 10**9)
        return f"{datetime.fromtimestamp(s, UTC):%Y-%m-%d %H:%M:%S}.{rest // 10**6:03d} UTC"

    return m.map(text, plain)


def duration_true(s: Signal) -> Measure:
    """Total time that s was true."""
    out = Signal(s.line, N.Integral((s.node,), 0), 0)
    return Measure(out, out)


def _since(s: Signal, first: bool) -> Signal:
    """The time at which the level of s began; first: the first moment begins one, whatever the default."""
    at = s.changes()
    return P._hold(at | Signal(s.line, N.First(), False) if first else at, s.line.now(), None)


def duration_since_true(s: Signal) -> Measure:
    """Time since s became true, 0 while it is false."""
    since, now = _since(s, False), s.line.now()
    zero = s.line.now() * 0

    def span(b: Signal, begun: Signal) -> Signal:
        return b.with_(lambda c, t, x, z: F.when(c, t - x).otherwise(z), now, begun, zero, default=0, py=lambda c, t, x, z: t - x if c else 0)

    return Measure(span(s, since), span(_prev(s, False), _prev(since, None)))


def duration_of_current_level(s: Signal) -> Measure:
    since, now = _since(s, True), s.line.now()
    left = now.with_(lambda t, x: F.coalesce(t - x, F.lit(0)), _prev(since, None), default=0, py=lambda t, x: 0 if x is None else t - x, total=True)
    return Measure(now - since, left)


def linear_change(rate: Signal) -> Measure:
    """The integral of a rate per second."""
    out = Signal(rate.line, N.Integral((rate.node,), 0.0), 0.0) / 1e9
    return Measure(out, out)
