"""The suites of metrics over events of one's own, held against their SQL."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tempora import catalog
from tempora.operators import processors as P
from tempora.plans import inspect, suite, timeline
from tempora.plans import nodes as N
from tempora.plans.policy import Query

DIR = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def rows(spark, path, name, log):
    """(the query's rows, its SQL's rows) over a log of (event_id, user_id, event_type), an hour apart; rows are sorted."""
    events = [(n, START + timedelta(hours=i), u, k, 1.0, "{}") for i, (n, u, k) in enumerate(log)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    want = db.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    got = catalog.queries()[name](spark, os.fspath(path)).select(*cols).collect()
    return sorted(map(tuple, got)), sorted(want.fetchall())


def test_a_load_without_a_start_is_none(spark, tmp_path):
    """A web load that didn't come later than the one before, then a mobile view whose start is 0: neither counts."""
    got, want = rows(spark, tmp_path, "app_page_load", [(13821, 1, "view"), (16631, 1, "view"), (24000, 1, "view"), (24516, 1, "error"), (13780, 2, "view"), (58000, 2, "view")])
    assert got == want
    assert len(got) == 6


@pytest.mark.parametrize("how, split", [("windows", None), ("fold", None), ("windows", 60)])
def test_a_task_gets_a_bounded_number_of_rows(spark, monkeypatch, how, split):
    """1000 events of 15 users, in tasks of 100 or so: the same results, and no task sorts them all."""

    def build(split=None):
        t = suite.timeline(spark, DIR, "k", split=split)
        return Query(t).metric("m", t["k"].has_changed("6h").count_changes())

    want = sorted(map(tuple, build().run("u", "t", {"event_id": "e"}, how="windows").collect()))
    monkeypatch.setattr(timeline, "SHARE", 100, raising=False)
    df = build(split).run("u", "t", {"event_id": "e"}, how=how)
    assert sorted(map(tuple, df.collect())) == want and len(want) == 1000
    if split:  # its last depth was stored: the plan that is left reads it
        return
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 400


def test_streams_and_checks_count_nothing(spark):
    """Only a run counts rows; a stream has no end."""
    t = suite.timeline(spark, DIR, "k")
    q = Query(t).metric("m", t["k"])
    assert inspect.verify(q) == [] and t.spread(t.rows) is None


def test_equal_functions_are_one_node(spark):
    """Scopes that are written twice are computed once, so that their windows share a sort; other values or texts aren't one."""
    t = suite.timeline(spark, DIR, "k", "v")
    same = [t["v"].cast("int"), t["v"].cast("int"), t["k"].parse("int"), t["k"].parse("int"), P.scope_run(t["k"]), P.scope_run(t["k"])]
    other = [t["v"].cast("bigint"), t["k"].parse("int", 5), t["k"].starts_with("a"), t["k"].starts_with("b"), t["v"].map(lambda c: c + 1, 0.0), t["v"].map(lambda c: c + 2, 0.0)]
    number = N.canonical([s.node for s in same + other])[1]
    got = [number[id(s.node)] for s in same + other]
    assert got[0] == got[1] and got[2] == got[3] and got[4] == got[5] and len(set(got)) == 9


@pytest.mark.parametrize("name, sorts", [("app_startup", 4), ("app_page_load", 4), ("app_network", 4)])
def test_sorts_of_scoped_metrics(spark, name, sorts):
    """One sort for the events, one for the timers' moments, one for each scope, none to go back."""
    plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") <= sorts
