"""Windows against the fold, moment by moment, on random timelines with ties and timers that hit events."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import fold
from tempora.operators import measurements as M
from tempora.operators import processors as P
from tempora.plans import inspect, policy
from tempora.plans.policy import Query
from tempora.plans.timeline import Field, Timeline

FIELDS = {"c": Field("bigint"), "d": Field("bigint"), "b": Field("boolean"), "r": Field("double"), "x": Field("bigint", volatile=True)}


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    rows = []
    for u in range(30):
        t = rng.choice([0, 1, 7, 1000])
        for n in range(rng.randint(1, 40)):
            t += rng.choice([0, 1, 1, 2, 3, 5, 17])
            maybe = lambda v: v if rng.random() < 0.5 else None
            rows.append((u, t, n, maybe(rng.randrange(3)), maybe(rng.randrange(50)), maybe(rng.random() < 0.5), maybe(float(rng.randrange(4))), maybe(rng.randrange(3))))
    return spark.createDataFrame(rows, "k int, t bigint, n bigint, c bigint, d bigint, b boolean, r double, x bigint").repartition(3).cache()


def scopes(t):
    return P.edge_latch(t["c"], t.const(True), 4).count_changes()


SIGNALS = {
    "clocks": lambda t: [t["x"], t["x"].clock(), t["d"].clock(), t.event_clock()],
    "latches": lambda t: [P.edge_latch(t["c"], t["d"]), P.edge_latch(t["c"], t["d"], 3), P.level_latch(t["b"], t["d"]), t["b"].has_been_true(), t["b"].has_been_true(5), t["c"].has_changed(), t["c"].has_changed(2)],
    "accumulate": lambda t: [P.accumulate(t["c"], t["d"], 3, lambda c: c > 0), t["c"].count_changes(), P.make_tuple(t["c"], t["b"]).count_changes()],
    "folds": lambda t: [P.state_fold(f, t["d"], t["c"].clock(), s) for f in ("SUM", "MIN", "MAX") for s in (None, t["b"])] + [P.state_fold(f, t["b"], t["c"].clock(), t["r"] > 1, i) for f, i in (("AND", None), ("OR", True))],
    "windows": lambda t: [P.sliding_window(t["c"], t["d"], 2, lambda q, g: F.array_max(q) * 1000 + g, -1, 0, lambda q, g: max(q) * 1000 + g)] + [P.sliding_time_window(t["c"], t["d"], 4, how, 0, 0) for how in ("count", "sum", "min", "max")] + [t["c"].moving_average(3)],
    "priors": lambda t: [t["d"].prior_value(t["c"].clock()), t["d"].prior_value(t["c"].clock(), t["b"]), t["c"].prior_different_value(), P.duration_of_previous_level(t["c"])],
    "generators": lambda t: [P.square_wave(t, 5), P.square_wave(t, 5, 2).count_changes(), P.monotonic_steps(t, 3, 2, 7), P.monotonic_steps(t, 3, 2, 7, 3)],
    "filters": lambda t: [P.FilterBuilder(t["c"]).filter_values(1, 2).then_filter(t["b"]).build_clock_filter(), P.FilterBuilder(t["d"]).filter_fn(lambda c: c > 20).build_value_filter(), P.sessionized(t, "d", t["b"], -1)],
    "live": lambda t: [P.liveness(t["c"].clock(), F.col("b") & (F.col("d") > 10), 6)],
    "stacked": lambda t: [scopes(t), P.edge_latch(scopes(t), t["d"], 3), P.square_wave(t, 9) & P.edge_latch(scopes(t), t.const(True), 5), P.StateMachineBuilder(t["d"].clock(), t["d"]).scoped(scopes(t)).saturating(3)],
    "measures": lambda t: [M.duration_true(t["b"]), M.duration_since_true(t["b"]), M.duration_of_current_level(t["c"]), M.linear_change(t["r"]), M.peek(t["d"]).scoped(t["b"]), M.peek_timestamp(t)],
    "scoped": lambda t: [m.scoped(scopes(t)) for m in (M.duration_true(t["b"]), M.duration_since_true(t["b"]), M.duration_of_current_level(t["c"]), M.linear_change(t["r"]), M.peek(t["d"]))],
    "combined": lambda t: [M.duration_true(t["b"]).combine(lambda a, b: a - b, M.duration_since_true(t["b"]).map(lambda v: v * 2))],
}
POLICIES = {
    "events": lambda t: {},
    "filter": lambda t: {"event_filter": t["c"] > 0},
    "trigger": lambda t: {"at_events": False, "trigger": P.edge_latch(t["c"], t["d"], 3)},
    "left": lambda t: {"left_side": t["b"], "gate": [t["r"] < 3]},
    "every": lambda t: {"at_events": False},
    "reset": lambda t: {"reset": scopes(t)},
}


def rows(q, how):
    out = q.run("k", "t", how=how).collect()
    return sorted((r.k, r.t, *(None if isinstance(v, float) and v != v else round(v, 9) if isinstance(v, float) else v for v in r[2:])) for r in out)


PAIRS = [(n, p) for n in sorted(SIGNALS) for p in sorted(POLICIES) if p == "events" or n in ("stacked", "measures", "scoped", "latches")]


@pytest.mark.parametrize("name, policy", PAIRS)
def test_windows_equal_fold(events, name, policy):
    t = Timeline.of(events, "k", "t", ["n"], FIELDS, merge=policy != "filter")
    q = Query(t, **POLICIES[policy](t))
    if policy == "every":
        q.every(6)
    for i, s in enumerate(SIGNALS[name](t)):
        q.metric(f"m{i}", s, interval=f"i{i}" if policy == "reset" and name in ("measures", "scoped") else None)
    got, want = rows(q, "windows"), rows(q, "fold")
    assert got == want and want


@pytest.mark.parametrize("name, policy", [("clocks", "events"), ("live", "events"), ("folds", "events"), ("priors", "events"), ("latches", "filter"), ("stacked", "every"), ("scoped", "reset"), ("measures", "left")])
def test_split_entities(events, name, policy):
    """Entities that are cut into chunks of a few rows, against the fold."""

    def build(split):
        t = Timeline.of(events, "k", "t", ["n"], FIELDS, merge=policy != "filter", split=split)
        q = Query(t, **POLICIES[policy](t))
        if policy == "every":
            q.every(6)
        signals = SIGNALS[name](t)[:4]
        for i, s in enumerate(signals):
            q.metric(f"m{i}", s, interval=f"i{i}" if policy == "reset" and name in ("measures", "scoped") else None)
        return t, q

    t, q = build(7)
    got = rows(q, "windows")
    assert got == rows(build(None)[1], "fold") and t.splitter() is not None


def test_what_cannot_be_split(events):
    t = Timeline.of(events, "k", "t", ["n"], FIELDS, split=7)
    with pytest.raises(ValueError):
        Query(t).metric("m", t["c"].moving_average(3)).run("k", "t")
    assert Timeline.of(events, "k", "t", ["n"], FIELDS, split=1000).splitter() is None


@pytest.mark.parametrize("name", ["duration_true", "linear_change", "scoped"])
def test_order_of_declaration(events, name):
    """A measurement is the same whether timers are declared before it or after it."""

    def build(first):
        t = Timeline.of(events, "k", "t", ["n"], FIELDS)
        q = Query(t, at_events=False)
        timer = lambda: P.edge_latch(t["c"], t["d"], 3)
        measure = {"duration_true": lambda: M.duration_true(t["b"]), "linear_change": lambda: M.linear_change(t["r"]), "scoped": lambda: M.duration_true(t["b"]).scoped(scopes(t))}[name]
        if first:
            q.metric("m", measure()).metric("l", timer()).every(4)
        else:
            q.every(4).metric("l", timer()).metric("m", measure())
        return sorted(map(str, q.run("k", "t").select("k", "t", "m", "l").collect()))

    assert build(True) == build(False) != []


def test_running_totals_at_inserted_moments(spark):
    """b true at 0 and 10, measured every 4."""
    df = spark.createDataFrame([("u", 0, 0, True), ("u", 10, 1, True)], "k string, t bigint, n bigint, b boolean")
    t = Timeline.of(df, "k", "t", ["n"], {"b": FIELDS["b"]})
    got = Query(t, at_events=False).metric("m", M.duration_true(t["b"])).every(4).metric("l", P.edge_latch(t["b"], t["b"], 4)).run("k", "t").orderBy("t").collect()
    assert [(r.t, r.m, r.l) for r in got] == [(4, 4, False), (8, 8, False)]


def test_steps_begin_with_the_first_moment(spark):
    df = spark.createDataFrame([("u", 1003, 0, 1), ("u", 1011, 1, 1), ("u", 1030, 2, 1)], "k string, t bigint, n bigint, c bigint")
    t = Timeline.of(df, "k", "t", ["n"], {"c": FIELDS["c"]})
    got = Query(t).metric("m", P.monotonic_steps(t, 5, 2, 10)).run("k", "t").orderBy("t").collect()
    assert [r.m for r in got] == [5, 7, 11]


def test_boundaries_are_whole_nanoseconds(spark):
    """An event one nanosecond before a boundary, far from 0: doubles would lose it."""
    far = 1_704_067_200 * 10**9
    df = spark.createDataFrame([("u", far - 1, 0, 1), ("u", far + 9, 1, 1)], "k string, t bigint, n bigint, c bigint")
    t = Timeline.of(df, "k", "t", ["n"], {"c": FIELDS["c"]})
    got = Query(t, at_events=False, trigger=P.square_wave(t, 10**9)).metric("m", t["c"]).run("k", "t").collect()
    assert sorted(r.t for r in got) == [far - 1, far]


def test_liveness_reads_each_event(spark):
    """Of two events at one time the first is live by its own fields, not the second."""
    df = spark.createDataFrame([("u", 0, 0, 1, 1), ("u", 3, 1, 2, None), ("u", 3, 2, None, 5), ("u", 9, 3, 0, 0)], "k string, t bigint, n bigint, c bigint, d bigint")
    t = Timeline.of(df, "k", "t", ["n"], {k: FIELDS[k] for k in "cd"})
    got = Query(t).metric("m", P.liveness(t["c"].clock(), (F.col("c") == 2) & F.col("d").isNull(), 5)).run("k", "t").orderBy("t").collect()
    assert [r.m for r in got] == [True, False, False]


def test_order_by_several_columns_and_nulls(spark):
    """Ties are ordered by all columns told; events without a time are none; null keys are one entity; clashing columns don't matter."""
    rows = [("u", 5, 2, "a", 1, 0), ("u", 5, 1, "z", 2, 0), ("u", 5, 1, "b", 3, 0), ("u", None, 9, "c", 9, 0), (None, 1, 1, "a", 4, 0), (None, 2, 1, "a", None, 0), ("u", 9, 0, "a", None, 0)]
    df = spark.createDataFrame(rows, "k string, t bigint, n int, o string, c bigint, _ts int")
    for merge, want in ((True, [(None, 1, 4, 1), (None, 2, 4, 1), ("u", 5, 1, 3), ("u", 9, 1, 3)]), (False, [(None, 1, 4, 1), (None, 2, 4, 1), ("u", 5, 3, 1), ("u", 5, 2, 2), ("u", 5, 1, 3), ("u", 9, 1, 3)])):
        for how, split in (("windows", None), ("fold", None), ("windows", 2)):
            t = Timeline.of(df, "k", "t", ["n", "o"], {"c": FIELDS["c"]}, merge, split=split)
            q = Query(t).metric("m", t["c"]).metric("i", t["c"].clock()).metric("l", P.edge_latch(t["c"], t["c"], 2))
            got = [tuple(r)[:4] for r in q.run("k", "t", how=how).collect()]
            assert sorted(got, key=lambda r: (r[0] or "", r[1], r[3])) == want


def test_own_operators_and_names(spark, events):
    t = Timeline.of(events, "k", "t", ["n"], FIELDS)
    q = Query(t).metric("m", t.custom(lambda s, ts, d: (s + d, s + d, 5), t["d"], init=0, kind="bigint", default=0))
    assert q.folded and q.run("k", "t").count() == Query(t).metric("m", t["d"]).run("k", "t").count()
    with pytest.raises(ValueError):
        q.metric("m", t["c"])
    with pytest.raises(KeyError):
        t["nothing"]


def test_finite_machines(events):
    """Maps composed by doubling, against the general machine; an entity of too many moments is an error."""
    f = lambda s, x: (2 * s + x) % 5

    def build(scope, how):
        t = Timeline.of(events, "k", "t", ["n"], FIELDS)
        b = P.StateMachineBuilder(t["d"].clock(), t["c"]).init_state(3).transition_fn(f)
        b = b.scoped(scopes(t)) if scope else b
        return Query(t).metric("m", b.build("bigint") if how == "build" else b.finite(range(5), range(3), 64), "bigint")

    for scope in (False, True):
        want = rows(build(scope, "build"), "fold")
        assert rows(build(scope, "finite"), "windows") == want == rows(build(scope, "finite"), "fold")
    t = Timeline.of(events, "k", "t", ["n"], FIELDS)
    short = Query(t).metric("m", P.StateMachineBuilder(t["d"].clock(), t["c"]).init_state(3).transition_fn(f).finite(range(5), range(3), 4))
    with pytest.raises(Exception, match="more than 4 moments"):
        short.run("k").collect()


def test_fields_of_every_type(spark):
    """Times, arrays, enumerations (an unknown value is none), decimals: levels, changes and clocks in both forms."""
    rows = [("u", 1, 0, "2024-01-01 00:00:05", [1, 2], "b", "1.5"), ("u", 2, 1, None, None, "zz", None), ("u", 3, 2, "2024-01-01 00:00:06", [1, 2], "a", "1.5"), ("u", 4, 3, None, [], None, "2.5")]
    df = spark.createDataFrame(rows, "k string, t bigint, n bigint, w string, a array<bigint>, e string, x string")
    fields = {"w": Field("timestamp"), "a": Field("array<bigint>"), "e": Field("string", values=("a", "b")), "x": Field("decimal(20,2)")}
    t = Timeline.of(df, "k", "t", ["n"], fields)
    q = Query(t).metric("w", t["w"].timestamp()).metric("a", t["a"].count_changes()).metric("r", t["e"].rank()).metric("c", t["e"].clock()).metric("x", t["x"].count_changes())
    want = [(1704067205, 1, 1, 1, 1), (1704067205, 1, 1, 1, 1), (1704067206, 1, 0, 2, 1), (1704067206, 2, 0, 2, 2)]
    for how in ("windows", "fold"):
        assert [tuple(r)[2:] for r in q.run("k", "t", how=how).orderBy("t").collect()] == want


def test_inspection(spark, events):
    t = Timeline.of(events, "k", "t", ["n"], FIELDS)
    q = Query(t, gate=[t["b"]]).metric("m", P.edge_latch(t["c"], t["d"], 3))
    assert inspect.verify(q) == [] and "+3ns at" in inspect.describe(q) and inspect.graph(q).startswith("digraph")
    assert inspect.verify(Query(t, at_events=False).metric("m", t["c"])) == ["nothing is ever measured"]
    assert inspect.verify(Query(t, gate=[t["c"]]).metric("m", t["c"])) == ["gate0 isn't boolean but bigint"]
    assert "BOOLEAN" in inspect.verify(Query(t).metric("m", t["c"] & t["d"]))[0].upper()
    took = fold.timed_nodes(q, [{"ts": i, "c": i % 2, "d": i} for i in range(10)])
    assert len(took) == len(inspect.describe(q).splitlines()) - 2 and all(v >= 0 for v in took.values())
    df, told = policy.observed(q.run("k"), "watch", "k")
    n = df.count()
    assert told.get["rows"] == n
