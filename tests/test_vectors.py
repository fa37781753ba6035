"""Small timelines with known results, fixed values of FIXTURES.md section 3 among them; times are 0, 1, 2, ... ns unless given."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tempora.functions import levels as L
from tempora.operators import measurements as M, processors as P
from tempora.plans.policy import Query
from tempora.plans.timeline import Field, Signal, Timeline

FIELDS = {"c": Field("bigint"), "d": Field("bigint"), "b": Field("boolean"), "r": Field("double")}


def run(spark, rows, build, times=None, merge=True, **policy):
    """rows: (c, d, b, r) or shorter; the values of the metric m at each event."""
    data = [("u", t if times is None else times[t], t, *(list(r) + [None] * (4 - len(r)))) for t, r in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, t bigint, n bigint, c bigint, d bigint, b boolean, r double")
    line = Timeline.of(df, "k", "t", ["n"], FIELDS, merge, ["n"])
    out = Query(line, **policy).metric("m", build(line)).run("k", "t").orderBy("t").collect()
    return [r.m for r in out]


def bools(*v):
    return [(None, None, x) for x in v]


def test_accumulator(spark):
    assert run(spark, [(0, 1), (1, 1), (1, 2), (2, 3)], lambda t: P.accumulate(t["c"], t["d"])) == [0, 1, 1, 4]
    even = lambda c: c % 2 == 0
    assert run(spark, [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4)], lambda t: P.accumulate(t["c"], t["d"], 0, even)) == [0, 0, 2, 2, 6]


def test_edge_latch(spark):
    rows = [(1, 1), (0, 2), (0, 3), (1, 4), (1, 5), (0, 6)]
    assert run(spark, rows, lambda t: P.edge_latch(t["c"], t["d"])) == [1, 2, 2, 4, 4, 6]
    rows = [(1, 1), (1, 2), (1, 3), (0, 4), (0, 5), (0, 6), (1, 7), (0, 8)]
    assert run(spark, rows, lambda t: P.edge_latch(t["c"], t["d"], 2)) == [1, 1, 0, 4, 4, 0, 7, 8]


def test_level_latch(spark):
    rows = [(1, 1), (0, 2), (1, 3), (0, 4), (0, 5), (1, 6), (0, 7)]
    assert run(spark, rows, lambda t: P.level_latch(t["c"] == 1, t["d"])) == [1, 1, 3, 3, 3, 6, 6]


def test_level_latch_with_duration(spark):
    control = [True, False, False, True, True, False, False, False]
    rows = [(None, d, c) for c, d in zip(control, [1, 2, 2, 2, 2, 3, 2, 2], strict=True)]
    assert run(spark, rows, lambda t: P.level_latch(t["b"], t["d"], 2, "bigint")) == [1, 1, 0, 2, 2, 2, 0, 0]


def test_duration_of_previous_level(spark):
    assert run(spark, [(x,) for x in (0, 0, 1, 1, 1, 0)], lambda t: P.duration_of_previous_level(t["c"])) == [0, 0, 2, 2, 2, 3]


def test_liveness(spark):
    live = [1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    want = [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0]
    # the clock is the time of the last live event, counted from 1 so that the first one is a change
    rows, last = [], 0
    for t, x in enumerate(live):
        last = t + 1 if x else last
        rows.append((last, x))
    assert run(spark, rows, lambda t: P.liveness(t["c"], F.col("d") > 0, 6)) == [bool(x) for x in want]


def test_generators(spark):
    rows = [(0,)] * 100
    assert run(spark, rows, lambda t: P.square_wave(t, 10)) == [t // 10 % 2 == 1 for t in range(100)]
    assert run(spark, rows, lambda t: P.monotonic_steps(t, 0, 1, 10)) == [t // 10 for t in range(100)]
    assert run(spark, [(0,), (0,)], lambda t: P.square_wave(t, 10).count_changes(), times=[0, 95]) == [0, 9]


def test_durations(spark):
    assert run(spark, bools(True, True, True, False, False, True, True), lambda t: M.duration_true(t["b"])) == [0, 1, 2, 3, 3, 3, 4]
    assert run(spark, bools(True, True, False, False, True, True), lambda t: M.duration_since_true(t["b"])) == [0, 1, 0, 0, 0, 1]
    assert run(spark, bools(True, True, False, False, True, True), lambda t: M.duration_of_current_level(t["b"])) == [0, 1, 0, 1, 0, 1]


def test_linear_change_and_scope(spark):
    rows = [(0, None, None, 2.0), (0, None, None, 0.0), (1, None, None, 4.0), (1,)]
    times = [0, 10**9, 3 * 10**9, 5 * 10**9]
    assert run(spark, rows, lambda t: M.linear_change(t["r"]), times) == [0.0, 2.0, 2.0, 10.0]
    assert run(spark, rows, lambda t: M.linear_change(t["r"]).scoped(t["c"]), times) == [0.0, 2.0, 0.0, 8.0]


def test_scope_takes_the_left_limit(spark):
    rows = [(0, 3), (0, 5), (1, 9), (1, 10)]
    assert run(spark, rows, lambda t: M.peek(t["d"]).scoped(t["c"])) == [3, 5, 4, 5]


def test_sliding_windows(spark):
    rows = [(1, 1), (2, 2), (2, 7), (3, 3), (4, 4)]
    emit = lambda q, g: F.concat_ws(",", F.transform(q, lambda x: x.cast("string")), g.cast("string"))
    assert run(spark, rows, lambda t: P.sliding_window(t["c"], t["d"], 2, emit, -1, "")) == ["1,-1", "1,2,-1", "1,2,-1", "2,3,1", "3,4,2"]
    assert run(spark, rows, lambda t: P.sliding_time_window(t["c"], t["d"], 2, emit, -1, "")) == ["1,-1", "1,2,-1", "2,1", "3,2", "3,4,2"]


def test_moving_average_and_priors(spark):
    rows = [(x, x) for x in (0, 2, 2, 4, 9)]
    got = run(spark, rows, lambda t: t["c"].moving_average(2))
    assert got[0] != got[0] and got[1:] == [2.0, 2.0, 3.0, 6.5]
    assert run(spark, rows, lambda t: t["c"].prior_different_value()) == [0, 0, 0, 2, 4]
    assert run(spark, rows, lambda t: t["c"].prior_value(t["d"].clock())) == [0, 0, 2, 2, 4]


def test_merge(spark):
    rows, times = [(1,), (2,), (3,), (4,)], [0, 0, 1, 20]
    assert run(spark, rows, lambda t: t["c"], times) == [2, 3, 4]
    assert run(spark, rows, lambda t: t["c"], times, merge=False) == [1, 2, 3, 4]
    assert run(spark, rows, lambda t: t["c"].clock(), times) == [2, 3, 4]
    assert run(spark, rows, lambda t: t["c"].count_changes(), times) == [1, 2, 3]


def test_nothing_fires_after_the_last_event(spark):
    line = lambda t: P.edge_latch(t["c"], t["d"], 2)
    rows = [(1, 5), (1, 6)]
    data = spark.createDataFrame([("u", 0, 0, 1, 5), ("u", 1, 1, 1, 6)], "k string, t bigint, n bigint, c bigint, d bigint")
    t = Timeline.of(data, "k", "t", ["n"], {k: FIELDS[k] for k in "cd"})
    q = Query(t, at_events=False, trigger=line(t)).metric("m", t["d"])
    assert [r.t for r in q.run("k", "t").collect()] == [0]
    assert run(spark, rows, line) == [5, 5]


def test_truth_and_units():
    with pytest.raises(TypeError):
        bool(Signal(None, None, 0))
    assert [L.duration(x) for x in ("3ns", "2us", "5ms", "90s", "1m", "2h", 7)] == [3, 2000, 5 * 10**6, 90 * 10**9, 60 * 10**9, 7200 * 10**9, 7]
    with pytest.raises(ValueError):
        L.duration("5 days")


def test_filter_needs_a_predicate(spark):
    df = spark.createDataFrame([("u", 0, 0, 1)], "k string, t bigint, n bigint, c bigint")
    t = Timeline.of(df, "k", "t", ["n"], {"c": FIELDS["c"]})
    with pytest.raises(ValueError):
        P.FilterBuilder(t["c"]).build_clock_filter()


def test_one_exchange(spark):
    from tempora.plans import suite

    for name in ("session_metrics", "playtime", "edge_latch_ttl", "fold_max_scoped", "periodic_measure"):
        plan = suite.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, name
