"""The tail of a query: when to measure, what to let out, and interval metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempora.functions import levels as L
from tempora.operators import fold
from tempora.operators.measurements import Measure, peek
from tempora.operators.processors import if_
from tempora.plans import nodes as N
from tempora.plans.split import CHUNK
from tempora.plans.timeline import MEASURE, Signal, Timeline


@dataclass
class Query:
    """Metrics of a timeline, in the order in which they are added."""

    line: Timeline
    at_events: bool = True
    event_filter: Signal | None = None
    trigger: Signal | None = None
    left_side: Signal | None = None
    gate: Sequence[Measure | Signal] = ()
    reset: Measure | Signal | None = None
    metrics: dict[str, tuple[Measure, str | None, str | None]] = field(default_factory=dict)
    periods: list[int] = field(default_factory=list)

    def metric(self, name: str, m: Measure | Signal, kind: str | None = None, interval: str | bool | None = None) -> Query:
        """interval: the name of a further metric, the difference from the row let out before; True derives the name."""
        if not name.isidentifier():
            raise ValueError(f"no identifier: {name!r}")
        if interval is True:
            interval = name.replace("life_navigation", "interval").replace("life_session", "interval")
            if interval == name:
                raise ValueError(f"no interval name follows from {name!r}")
        for n in (name, interval):
            if n and n in self.names():
                raise ValueError(f"two metrics of the name {n!r}")
        self.metrics[name] = (peek(m) if isinstance(m, Signal) else m, kind, interval or None)
        return self

    def names(self) -> list[str]:
        return [n for name, (_, _, interval) in self.metrics.items() for n in (name, interval) if n]

    def every(self, period: int | str) -> Query:
        """Measure also at each multiple of the period since an entity's first event."""
        self.periods.append(L.duration(period))
        return self

    def roots(self) -> dict[str, N.Node]:
        """The nodes that the policy and the metrics read, by what for."""

        def value(m: Measure | Signal) -> N.Node:
            m = peek(m) if isinstance(m, Signal) else m
            return (m.right if self.left_side is None else if_(self.left_side, m.left, m.right)).node

        out: dict[str, N.Node] = {}
        if self.event_filter is not None:
            out["filter"] = self.event_filter.node
        if self.trigger is not None:
            out["trigger"] = self.trigger.changes().node
        out |= {f"gate{i}": value(g) for i, g in enumerate(self.gate)}
        if self.reset is not None:
            out["reset"] = value(self.reset)
        return out | {f"m_{n}": value(m) for n, (m, _, _) in self.metrics.items()}

    @property
    def folded(self) -> bool:
        """Whether a node has no window form."""
        return any(n.folded for n in N.ordered(list(self.roots().values())))

    def run(self, key: str, ts: str | None = None, carried: dict[str, str] | None = None, how: str = "auto") -> DataFrame:
        """key, ts (ns), carried columns, metrics: a row for each measurement that is let out.

        how: windows, fold, or auto: windows wherever every node has that form."""
        self.line.measured()
        if how == "fold" or (how == "auto" and self.folded):
            return fold.run(self, key, ts, carried or {})
        return self._windows(key, ts, carried or {})

    def schema(self, key: str, ts: str | None, carried: dict[str, str]) -> StructType:
        return self._windows(key, ts, carried).schema

    def _windows(self, key: str, ts: str | None, carried: dict[str, str]) -> DataFrame:
        line, roots = self.line, self.roots()
        df, cols = line.lower(list(roots.values()), [N.Timer(period=p, measure=True) for p in self.periods])
        got = dict(zip(roots, cols, strict=True))
        when = F.col(L.EXT) & got.get("filter", F.lit(True)) if self.at_events else F.lit(False)
        if MEASURE in df.columns:
            when = when | F.col(MEASURE)
        if self.trigger is not None:
            when = when | got["trigger"]
        for i in range(len(self.gate)):
            when = when & got[f"gate{i}"]
        values: dict[str, Column] = {f"_m_{n}": got[f"m_{n}"].cast(kind) if kind else got[f"m_{n}"] for n, (_, kind, _) in self.metrics.items()}
        if self.reset is not None:
            values["_reset"] = got["reset"]
        chunk = [CHUNK] if CHUNK in df.columns else []
        df = df.where(when).select(L.KEY, *chunk, L.TS, L.SEQ, *line.carried, *[c.alias(n) for n, c in values.items()])
        lagged = [f"_m_{n}" for n, (_, _, interval) in self.metrics.items() if interval]
        df = line.previous(df, lagged + ["_reset"] * bool(lagged and self.reset is not None))
        names: list[Column] = [F.col(L.KEY).alias(key)]
        if ts:
            names.append(F.col(L.TS).alias(ts))
        names += [F.col(f"_c_{c}").alias(a) for c, a in carried.items()]
        for n, (_, _, interval) in self.metrics.items():
            x = F.col(f"_m_{n}")
            names.append(x.alias(n))
            if interval:
                last = F.col(f"_b__m_{n}")["v"]
                before = F.coalesce(last, F.lit(0))
                if self.reset is not None:
                    before = F.when(F.col("_reset").eqNullSafe(F.col("_b__reset")["v"]) | last.isNull(), before).otherwise(F.lit(0))
                names.append((x - before).alias(interval))
        return df.select(*names)


def summary(df: DataFrame, key: str, order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The last row of each entity, without a window: the greatest by order."""
    best: Any = F.max_by(F.struct(*names), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def observed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, Observation]:
    """df, and what is observed while it is computed: rows, and how many entities about."""
    told = Observation(name)
    return df.observe(told, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(key).alias("entities")), told
