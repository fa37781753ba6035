"""Queries over unbounded input with Structured Streaming.

Any query runs as a fold whose state Spark keeps: an entity's events wait in a list
state until the watermark has passed them by as much as the query looks ahead, are put
in order and fed to the entity's machine, whose own state is one value. Waiting events
are only appended, and read when the timer of the earliest is due. What Spark
checkpoints is enough to go on after a restart. Up to an entity's last event the rows
are those of the batch query; later events than the watermark are dropped by Spark.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tempora.functions import levels as L
from tempora.operators.fold import Machine
from tempora.plans import nodes as N
from tempora.plans.policy import Query

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    def __init__(self, machine: Machine, merge: bool, extras: list[str], ts: bool, idle: bool, names: list[str]) -> None:
        self.machine, self.merge, self.extras, self.ts, self.idle, self.names = machine, merge, extras, ts, idle, names

    def _row(self, *values: Any) -> Row:
        return Row(**dict(zip(self.names, values, strict=True)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.kept = handle.getValueState("machine", "machine binary")

    def close(self) -> None:
        pass

    def _wake(self, ns: int) -> None:
        self.handle.registerTimer(-(-(ns + self.machine.look_ahead) // 1_000_000) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        chunk = [r.asDict(True) for r in rows]
        if chunk:
            self.waiting.appendValue((pickle.dumps(chunk),))
            self._wake(min(r[L.TS] for r in chunk))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1_000_000 - self.machine.look_ahead
        rows = [r for (chunk,) in self.waiting.get() for r in pickle.loads(chunk)]
        rows.sort(key=lambda r: (r[L.TS], tuple(r[L.SEQ].values()) if isinstance(r[L.SEQ], dict) else (r[L.SEQ],)))
        state = pickle.loads(self.kept.get()[0]) if self.kept.exists() else self.machine.new()
        ahead = self._ahead(rows)
        due = [(r, a) for r, a in zip(rows, ahead, strict=True) if r[L.TS] <= until]
        out: list[Row] = []
        groups = itertools.groupby(due, key=lambda x: x[0][L.TS]) if self.merge else ((r[L.TS], [(r, a)]) for r, a in due)
        for at, group in groups:
            group = list(group)
            for when, got in self.machine.feed(state, at, [r for r, _ in group], group[-1][1]):
                tail = [group[-1][0][c] if when == at else None for c in self.extras]
                out.append(self._row(key[0], *([when] if self.ts else []), *tail, *got.values()))
        rest = rows[len(due) :]
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.appendValue((pickle.dumps(rest),))
        if rest:
            self._wake(rest[0][L.TS])
        if self.idle:
            for when, got in self.machine.idle(state, until):
                out.append(self._row(key[0], *([when] if self.ts else []), *[None] * len(self.extras), *got.values()))
            if state.queue:
                self._wake(state.queue[0])
        self.kept.update((pickle.dumps(state),))
        return iter(out)

    def _ahead(self, rows: list[dict]) -> list[dict[str, int]]:
        """For each row the times of the next live events behind it."""
        out, later = [], dict.fromkeys(self.machine.next_py, N.NEVER)
        for r in reversed(rows):
            out.append(dict(later))
            later = {n: r[L.TS] if live(r) else later[n] for n, live in self.machine.next_py.items()}
        return out[::-1]


def stream(query: Query, key: str, ts: str | None = None, carried: dict[str, str] | None = None, delay: str = "1 hour", idle: bool = False) -> DataFrame:
    """The streaming form of Query.run() over a timeline of unbounded events.

    idle: whether moments of the engine's own also fire once the watermark has passed
    them though no event followed; in batch nothing fires after an entity's last event.
    """
    carried = carried or {}
    line, machine = query.line, Machine(query)
    if missing := [n for n, py in machine.next_py.items() if py is None]:
        raise ValueError(f"{len(missing)} predicates on coming events have no form for plain values")
    spark = line.rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    rows, line.rows = line.rows, spark.createDataFrame([], line.rows.schema)
    try:
        schema = query.schema(key, ts, carried)
    finally:
        line.rows = rows
    stamped = rows.withColumn("_when", F.timestamp_micros(F.call_function("div", F.col(L.TS), F.lit(1000)))).withWatermark("_when", delay)
    fold = _Fold(machine, line.merge, [f"_c_{c}" for c in carried], ts is not None, idle, schema.names)
    return stamped.groupBy(L.KEY).transformWithState(statefulProcessor=fold, outputStructType=schema, outputMode="append", timeMode="eventTime")


def session_windows(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions that end when a gap passes without event, as Spark's own session windows."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(key, "n", "first", "last")
    )
