"""One query for each operator and policy, and composites, over the table events."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import levels as L
from tempora.operators import measurements as M
from tempora.operators import processors as P
from tempora.plans.policy import Query
from tempora.plans.timeline import Field, Timeline

HOUR = 3600 * 10**9
TYPES = ("view", "click", "error", "purchase", "signup")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FIELDS = {
    "k": Field("string"), "v": Field("double"), "amount": Field("double"), "digits": Field("string"),
    "page": Field("double", volatile=True), "kind": Field("string", values=TYPES),
}


def events(spark: SparkSession, sf_dir: str, by_day: bool = False) -> DataFrame:
    """The events as sparse patches: amount only with purchases, page only with views, digits only with clicks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "user_id", "event_id", (F.date_trunc("day", "ts") if by_day else F.col("ts")).alias("ts"), F.col("event_type").alias("k"), F.col("value").alias("v"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), F.when(F.col("event_type") == "view", F.col("value")).alias("page"),
        F.when(F.col("event_type") == "click", F.regexp_extract("props", "([0-9]+)", 1)).alias("digits"), F.col("event_type").alias("kind"),
    )


def timeline(spark: SparkSession, sf_dir: str, *fields: str, by_day: bool = False, merge: bool = True, split: int | None = None) -> Timeline:
    return Timeline.of(events(spark, sf_dir, by_day), "user_id", "ts", ["event_id"], {f: FIELDS[f] for f in fields}, merge, ["event_id"], split)


# The SQL side: a chain of selections, each from the one before, over the same patches.
W = "OVER (PARTITION BY user_id ORDER BY t, event_id)"
UPTO = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"
_BASE = """SELECT user_id, event_id, epoch_us({ts}) * 1000 AS t, event_type AS k, value AS v,
 CASE WHEN event_type = 'purchase' THEN value END AS amount, CASE WHEN event_type = 'view' THEN value END AS page,
 CASE WHEN event_type = 'click' THEN regexp_extract(props, '([0-9]+)', 1) END AS digits FROM events"""


def chain(*steps: str, by_day: bool = False, key: str = "user_id, event_id, ") -> str:
    """Each step is the text behind SELECT, the last without the key columns; {w} and {upto} are the windows, x the step before."""
    parts = ["s0 AS (" + _BASE.format(ts="date_trunc('day', ts)" if by_day else "ts") + ")"]
    full = [s.replace("{w}", W).replace("{upto}", UPTO) for s in steps]
    for i, s in enumerate(full[:-1]):
        parts.append(f"s{i + 1} AS (SELECT *, {s.replace('{x}', f's{i}')}" + ("" if "{x}" in s else f" FROM s{i}") + ")")
    last = full[-1]
    return "WITH " + ",\n".join(parts) + f"\nSELECT {key}{last}" + (f" FROM s{len(full) - 1}" if not re.search(r" FROM (s\d|\()", last) else "").replace("{x}", f"s{len(full) - 1}")


def query(name: str, oracle: str | None, *fields: str, **how: Any):
    """Register build(line), which returns signals or measures by metric name, at every event."""

    def deco(build: Callable[[Timeline], dict[str, Any]]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            line = timeline(spark, sf_dir, *fields, **how)
            q = Query(line)
            for n, m in build(line).items():
                q.metric(n, *(m if isinstance(m, tuple) else (m,)))
            return q.run("user_id", carried={"event_id": "event_id"})

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return build

    return deco


_AMT = "coalesce(last_value(amount IGNORE NULLS) {upto}, 0.0) AS a"
_CHG = "coalesce(k <> lag(k, 1, '') {w}, true) AS chg"

query("level_ffill", chain("coalesce(last_value(amount IGNORE NULLS) {upto}, 0.0) AS m"), "amount")(lambda t: {"m": t["amount"]})
query("field_clock", chain("count(amount) {upto} AS m, count(*) {upto} AS n"), "amount")(lambda t: {"m": t["amount"].clock(), "n": t.event_clock()})
query("volatile_reset", chain("coalesce(page, 0.0) AS m, count(*) {upto} AS n"), "page")(lambda t: {"m": t["page"], "n": t["page"].clock()})
_DAY = [_AMT + ", count(amount) {upto} AS c, lead(t) {w} AS nx"]
query("merge_simultaneous", chain(*_DAY, "a AS m, c AS n FROM s1 WHERE nx IS NULL OR nx <> t", by_day=True), "amount", by_day=True)(lambda t: {"m": t["amount"], "n": t["amount"].clock()})
query("no_merge", chain(*_DAY, "a AS m, c AS n", by_day=True), "amount", by_day=True, merge=False)(lambda t: {"m": t["amount"], "n": t["amount"].clock()})
query("map_arith", chain("v * 2 + 1 AS m, (v > 50 AND NOT k = 'view') <> (v <= 20) AS b, v / 4 - 1 AS d, k <> 'view' OR v >= 99 AS c"), "k", "v")(
    lambda t: {"m": t["v"] * 2 + 1, "b": ((t["v"] > 50) & ~(t["k"] == "view")) ^ (t["v"] <= 20), "d": t["v"] / 4 - 1, "c": (t["k"] != "view") | (t["v"] >= 99)}
)
query("parse_default", chain("coalesce(last_value(digits IGNORE NULLS) {upto}, '') AS g", "coalesce(try_cast(g AS BIGINT), -1) AS m, -7 AS n"), "digits", "k")(
    lambda t: {"m": t["digits"].parse("bigint", -1), "n": t["k"].parse("int", -7)}
)
query("starts_with", chain("starts_with(k, 'p') AS m"), "k")(lambda t: {"m": t["k"].starts_with("p")})
query("enum_rank", chain("CAST(list_position(['view','click','error','purchase','signup'], k) - 1 AS INT) AS m"), "kind")(lambda t: {"m": t["kind"].rank()})
query("epoch_seconds", chain("t // 1000000000 AS m"), "k")(lambda t: {"m": t.now().map(lambda c: F.timestamp_micros(F.call_function("div", c, F.lit(1000))), 0).timestamp()})
query("peek_timestamp_fmt", chain("strftime(make_timestamp(t // 1000), '%Y-%m-%d %H:%M:%S.%g') || ' UTC' AS m, t AS n"), "k")(lambda t: {"m": M.formatted(M.peek_timestamp(t)), "n": M.peek_timestamp(t)})
query("count_changes", chain(_CHG, "CAST(sum(chg::INT) {upto} AS BIGINT) AS m"), "k")(lambda t: {"m": t["k"].count_changes()})
query("accumulate", chain(_CHG, "round(coalesce(sum(CASE WHEN chg THEN v END) {upto}, 0), 4) AS m"), "k", "v")(lambda t: {"m": P.accumulate(t["k"], t["v"]).map(lambda c: F.round(c, 4), 0.0)})
query("accumulate_filtered", chain(_CHG, "round(5 + coalesce(sum(CASE WHEN chg AND k <> 'view' THEN v END) {upto}, 0), 4) AS m"), "k", "v")(
    lambda t: {"m": P.accumulate(t["k"], t["v"], 5.0, lambda c: c != "view").map(lambda c: F.round(c, 4), 0.0)}
)
_LATCH = "last_value(CASE WHEN chg THEN v END IGNORE NULLS) {upto} AS lv, last_value(CASE WHEN chg THEN t END IGNORE NULLS) {upto} AS lt"
query("edge_latch", chain(_CHG, _LATCH, "coalesce(lv, 0) AS m"), "k", "v")(lambda t: {"m": P.edge_latch(t["k"], t["v"])})
query("edge_latch_ttl", chain(_CHG, _LATCH, f"CASE WHEN t < lt + {6 * HOUR} THEN lv ELSE 0 END AS m"), "k", "v")(lambda t: {"m": P.edge_latch(t["k"], t["v"], "6h")})
query("level_latch", chain("coalesce(last_value(CASE WHEN k = 'view' THEN v END IGNORE NULLS) {upto}, 0) AS m"), "k", "v")(lambda t: {"m": P.level_latch(t["k"] == "view", t["v"])})
query("has_been_true", chain("bool_or(k = 'error') {upto} AS m"), "k")(lambda t: {"m": (t["k"] == "error").has_been_true()})
query("has_been_true_ttl", chain("k = 'view' AS b, lag(k, 1, '') {w} = 'view' AS pb", "last_value(CASE WHEN pb AND NOT b THEN t END IGNORE NULLS) {upto} AS ended", f"b OR coalesce(t < ended + {6 * HOUR}, false) AS m"), "k")(
    lambda t: {"m": (t["k"] == "view").has_been_true("6h")}
)
query("has_changed_ttl", chain(_CHG, _LATCH, f"t < lt + {12 * HOUR} AS m"), "k")(lambda t: {"m": t["k"].has_changed("12h")})
query(
    "moving_average",
    "WITH c AS (SELECT *, sum(chg::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM (" + chain("coalesce(last_value(amount IGNORE NULLS) {upto}, 0.0) AS a", "coalesce(a <> lag(a, 1, 0) {w}, a <> 0) AS chg", "*", key="") + ")),"
    " d AS (SELECT user_id, r, avg(a) OVER (PARTITION BY user_id ORDER BY r ROWS 2 PRECEDING) AS m FROM c WHERE chg)"
    " SELECT c.user_id, c.event_id, round(coalesce(d.m, 'NaN'::DOUBLE), 6) AS m FROM c LEFT JOIN d ON c.user_id = d.user_id AND c.r = d.r",
    "amount",
)(lambda t: {"m": t["amount"].moving_average(3).map(lambda c: F.round(c, 6), 0.0)})
query("prior_value", chain("coalesce(lag(v) {w}, 0) AS m"), "v", "k")(lambda t: {"m": t["v"].prior_value(t["k"].clock())})
query(
    "prior_different_value",
    "WITH c AS (SELECT *, sum(chg::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM (" + chain(_CHG, "*", key="") + "))"
    " SELECT c.user_id, c.event_id, coalesce(d.k, '') AS m FROM c LEFT JOIN c d ON d.user_id = c.user_id AND d.chg AND d.r = c.r - 1",
    "k",
)(lambda t: {"m": t["k"].prior_different_value()})
_EDGE = "starts_with(k, 's') <> lag(starts_with(k, 's'), 1, false) {w} AS edge"
_RUN = "CAST(sum(edge::INT) {upto} AS BIGINT) AS run"
query("prior_value_scoped", chain(_EDGE, _RUN, "coalesce(lag(v) OVER (PARTITION BY user_id, run ORDER BY t, event_id), 0) AS m"), "v", "k")(lambda t: {"m": t["v"].prior_value(t["k"].clock(), t["k"].starts_with("s"))})
query("if_cond", chain("CASE WHEN k = 'view' THEN v ELSE -v END AS m, CASE WHEN v > 80 THEN 2 WHEN v > 60 THEN 3 WHEN v > 20 THEN 1 ELSE 0 END AS n"), "k", "v")(
    lambda t: {"m": P.if_(t["k"] == "view", t["v"], t["v"] * -1), "n": P.cond((t["v"] > 20, t.const(1)), [(t["v"] > 80, t.const(2)), (t["v"] > 60, t.const(3))], t.const(0))}
)
query("tuple_change", chain(_AMT, "k <> lag(k, 1, '') {w} OR a <> lag(a, 1, 0) {w} AS chg", "CAST(sum(chg::INT) {upto} AS BIGINT) AS m"), "k", "amount")(
    lambda t: {"m": P.make_tuple(t["k"], t["amount"]).count_changes()}
)
for _name, _sql in {"SUM": "round(coalesce(sum(v) {over}, 0), 4)", "MIN": "coalesce(min(v) {over}, 0)", "MAX": "coalesce(max(v) {over}, 0)"}.items():
    _scoped = "OVER (PARTITION BY user_id, run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"
    query(f"fold_{_name.lower()}", chain(_sql.replace("{over}", "{upto}") + " AS m"), "k", "v")(lambda t, n=_name: {"m": P.state_fold(n, t["v"], t["k"].clock()).map(lambda c: F.round(c, 4), 0.0)})
    query(f"fold_{_name.lower()}_scoped", chain(_EDGE, _RUN, _sql.replace("{over}", _scoped) + " AS m"), "k", "v")(
        lambda t, n=_name: {"m": P.state_fold(n, t["v"], t["k"].clock(), t["k"].starts_with("s")).map(lambda c: F.round(c, 4), 0.0)}
    )
for _name, _sql in {"AND": "bool_and(v > 3) {over}", "OR": "bool_or(v > 97) {over}"}.items():
    query(f"fold_{_name.lower()}", chain(_sql.replace("{over}", "{upto}") + " AS m"), "k", "v")(lambda t, n=_name: {"m": P.state_fold(n, t["v"] > (3 if n == "AND" else 97), t["k"].clock())})
    query(f"fold_{_name.lower()}_scoped", chain(_EDGE, _RUN, _sql.replace("{over}", _scoped) + " AS m"), "k", "v")(lambda t, n=_name: {"m": P.state_fold(n, t["v"] > (3 if n == "AND" else 97), t["k"].clock(), t["k"].starts_with("s"))})
query("filter_clock", chain("coalesce(last_value(CASE WHEN k IN ('view', 'click') THEN c END IGNORE NULLS) {upto}, 0) AS m FROM (SELECT *, count(*) {upto} AS c FROM s0)"), "k")(
    lambda t: {"m": P.FilterBuilder(t["k"]).filter_values("view", "click").build_clock_filter()}
)
query("filter_value", chain("coalesce(last_value(CASE WHEN v > 50 AND v < 90 THEN v END IGNORE NULLS) {upto}, 0) AS m"), "v")(lambda t: {"m": P.FilterBuilder(t["v"]).filter_fn(lambda c: c > 50).filter_fn(lambda c: c < 90).build_value_filter()})
query(
    "then_filter",
    chain("count(*) {upto} AS c", "last_value(CASE WHEN k = 'view' THEN c END IGNORE NULLS) {upto} AS c1", "coalesce(last_value(CASE WHEN v > 50 THEN coalesce(c1, 0) END IGNORE NULLS) {upto}, 0) AS m"),
    "k", "v",
)(lambda t: {"m": P.FilterBuilder(t["k"]).filter_values("view").then_filter(t["v"] > 50).build_clock_filter()})
query(
    "sessionized_field",
    chain(_AMT + ", (k = 'signup') <> lag(k = 'signup', 1, false) {w} AS edge", "max(CASE WHEN edge THEN t END) {upto} AS began, max(CASE WHEN amount IS NOT NULL THEN t END) {upto} AS asg", "CASE WHEN coalesce(began, 0) <= coalesce(asg, 0) THEN a ELSE -1 END AS m"),
    "k", "amount",
)(lambda t: {"m": P.sessionized(t, "amount", t["k"] == "signup", -1.0)})
_SID = f"CAST(1 + 2 * sum(coalesce(t - lt > {12 * HOUR}, false)::INT) {{upto}} AS BIGINT) AS sid"
query("session_id_ttl", chain("lag(t) {w} AS lt", _SID.replace("AS sid", "AS m")), "k")(lambda t: {"m": P.session_ids(t["k"].clock(), "12h")[1]})
query(
    "sliding_count_window",
    "WITH c AS (SELECT *, sum(chg::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM (" + chain(_CHG, "*", key="") + ")),"
    " d AS (SELECT user_id, r, max(v) OVER w AS hi, count(*) OVER w AS n, lag(v, 3, -1) OVER (PARTITION BY user_id ORDER BY r) AS gone FROM c WHERE chg WINDOW w AS (PARTITION BY user_id ORDER BY r ROWS 2 PRECEDING))"
    " SELECT c.user_id, c.event_id, round(d.hi + d.n * 1000 + d.gone, 4) AS m FROM c JOIN d ON c.user_id = d.user_id AND c.r = d.r",
    "k", "v",
)(lambda t: {"m": P.sliding_window(t["k"], t["v"], 3, lambda q, g: F.round(F.array_max(q) + F.size(q) * 1000 + g, 4), -1.0, 0.0)})
query(
    "sliding_time_window",
    chain(_CHG, f"count(CASE WHEN chg THEN 1 END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND CURRENT ROW) AS m"),
    "k", "v",
)(lambda t: {"m": (P.sliding_time_window(t["k"], t["v"], "12h", "count", 0.0, 0), "bigint")})
query(
    "duration_prev_level",
    chain(_CHG, "last_value(CASE WHEN chg THEN t END IGNORE NULLS) {upto} AS st", "CASE WHEN chg THEN t - coalesce(lag(st) {w}, 0) END AS d", "last_value(d IGNORE NULLS) {upto} AS m"),
    "k",
)(lambda t: {"m": P.duration_of_previous_level(t["k"])})
query(
    "liveness_lookahead",
    chain(f"coalesce(min(CASE WHEN k = 'view' THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < t + {6 * HOUR}, false) AS m"),
    "k",
)(lambda t: {"m": P.liveness(t["k"].clock(), F.col("k") == "view", "6h", lambda e: e["k"] == "view")})
query("square_wave", chain(f"(t // {5 * HOUR}) % 2 = 1 AS m"), "k")(lambda t: {"m": P.square_wave(t, "5h")})
query("monotonic_steps", chain(f"7 + 2 * (t // {5 * HOUR} - min(t) OVER (PARTITION BY user_id) // {5 * HOUR}) AS m"), "k")(lambda t: {"m": P.monotonic_steps(t, 7, 2, "5h")})
query("square_wave_edges", chain(f"CAST((t // {50 * HOUR}) - (min(t) OVER (PARTITION BY user_id) // {50 * HOUR}) + (min(t) OVER (PARTITION BY user_id) // {50 * HOUR}) % 2 AS BIGINT) AS m"), "k")(
    lambda t: {"m": P.square_wave(t, "50h").count_changes()}
)
_VIEW = "lag(k) {w} = 'view' AS pb, t - lag(t, 1, t) {w} AS dt"
query("duration_true", chain(_VIEW, "CAST(coalesce(sum(CASE WHEN pb THEN dt END) {upto}, 0) AS BIGINT) AS m"), "k")(lambda t: {"m": M.duration_true(t["k"] == "view")})
_SINCE = "(k = 'view') <> lag(k = 'view', 1, false) {w} AS e"
query("duration_since_true", chain(_SINCE, "max(CASE WHEN e THEN t END) {upto} AS st", "CASE WHEN k = 'view' THEN t - st ELSE 0 END AS m"), "k")(lambda t: {"m": M.duration_since_true(t["k"] == "view")})
query("duration_current_level", chain("k <> lag(k, 1, '') {w} AS e", "t - max(CASE WHEN e THEN t END) {upto} AS m"), "k")(lambda t: {"m": M.duration_of_current_level(t["k"])})
query("linear_change", chain("lag(v, 1, 0) {w} * (t - lag(t, 1, t) {w}) AS d", "round(sum(d) {upto} / 1e9, 2) AS m"), "v")(lambda t: {"m": M.linear_change(t["v"]).map(lambda c: F.round(c, 2))})
_TRUE = "CAST(coalesce(sum(CASE WHEN pb THEN dt END) {upto}, 0) AS BIGINT) AS d"
query("scoped_measure", chain(_VIEW + ", " + _EDGE, _TRUE, "d - coalesce(last_value(CASE WHEN edge THEN d END IGNORE NULLS) {upto}, 0) AS m"), "k")(lambda t: {"m": M.duration_true(t["k"] == "view").scoped(t["k"].starts_with("s"))})
query(
    "scoped_peek",
    chain(_EDGE + ", lag(v, 1, 0) {w} AS pv", "round(v - coalesce(last_value(CASE WHEN edge THEN pv END IGNORE NULLS) {upto}, 0), 6) AS m"),
    "k", "v",
)(lambda t: {"m": M.peek(t["v"]).scoped(t["k"].starts_with("s")).map(lambda c: F.round(c, 6))})
query("combined_measure", chain(_VIEW + ", " + _SINCE, _TRUE + ", max(CASE WHEN e THEN t END) {upto} AS st", "d // 1000000 + 2 * CASE WHEN k = 'view' THEN t - st ELSE 0 END AS m"), "k")(
    lambda t: {"m": M.duration_true(t["k"] == "view").map(lambda c: F.floor(c / 1000000)).combine(lambda a, b: a + 2 * b, M.duration_since_true(t["k"] == "view"))}
)


def policy(name: str, oracle: str | None, *fields: str, ts: str | None = None, events_: bool = True, **how: Any):
    """Register build(line) -> Query, run as it is."""

    def deco(build: Callable[[Timeline], Query]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(timeline(spark, sf_dir, *fields, **how)).run("user_id", ts, {"event_id": "event_id"} if events_ else None)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return build

    return deco


@policy("event_filter", chain(_AMT, "a AS m FROM s1 WHERE k = 'click' AND v > 10"), "k", "v", "amount")
def _(t: Timeline) -> Query:
    return Query(t, event_filter=((t["k"] == "click") & (t["v"] > 10))).metric("m", t["amount"])


@policy("trigger_signal", chain(_AMT + ", " + _SINCE, "a AS m FROM s1 WHERE e"), "k", "amount")
def _(t: Timeline) -> Query:
    return Query(t, at_events=False, trigger=t["k"] == "view").metric("m", t["amount"])


@policy("left_limit", chain(_VIEW + ", lag(v, 1, 0) {w} AS pv", _TRUE, "CASE WHEN k = 'error' THEN pv ELSE v END AS m, d AS n"), "k", "v")
def _(t: Timeline) -> Query:
    return Query(t, left_side=t["k"] == "error").metric("m", t["v"]).metric("n", M.duration_true(t["k"] == "view"))


@policy("output_gate", chain(_AMT, "v AS m FROM s1 WHERE a > 0 AND v > 30"), "v", "amount")
def _(t: Timeline) -> Query:
    return Query(t, gate=[t["amount"] > 0, t["v"] > 30]).metric("m", t["v"])


@policy("interval_metric", chain(_VIEW, _TRUE, "d AS life_session_m, d - lag(d, 1, 0) {w} AS interval_m FROM s2 WHERE k <> 'error'"), "k")
def _(t: Timeline) -> Query:
    return Query(t, event_filter=t["k"] != "error").metric("life_session_m", M.duration_true(t["k"] == "view"), interval=True)


@policy("interval_reset", chain(_VIEW, _TRUE, "d AS m, CASE WHEN starts_with(k, 's') IS NOT DISTINCT FROM lag(starts_with(k, 's')) {w} THEN d - lag(d, 1, 0) {w} WHEN lag(d) {w} IS NULL THEN d ELSE d END AS i"), "k")
def _(t: Timeline) -> Query:
    return Query(t, reset=t["k"].starts_with("s")).metric("m", M.duration_true(t["k"] == "view"), interval="i")


@policy(
    "periodic_measure",
    "WITH e AS (" + chain(_VIEW, _TRUE, "t, k, d", key="user_id, ") + f"""), b AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM e GROUP BY user_id),
    g AS (SELECT user_id, unnest(generate_series(t0 + {24 * HOUR}, t1, {24 * HOUR})) AS t FROM b), h AS (SELECT g.user_id, g.t FROM g JOIN b USING (user_id) WHERE g.t < b.t1)
    SELECT h.user_id, h.t AS at, e.d + CASE WHEN e.k = 'view' THEN h.t - e.t ELSE 0 END AS m FROM h ASOF JOIN e ON h.user_id = e.user_id AND h.t >= e.t""",
    "k", ts="at", events_=False,
)
def _(t: Timeline) -> Query:
    return Query(t, at_events=False).every("24h").metric("m", M.duration_true(t["k"] == "view"))


@policy("playtime", chain(_VIEW + ", lag(v) {w} > 50 AS pv", "CAST(coalesce(sum(CASE WHEN pb AND pv THEN dt END) {upto}, 0) AS BIGINT) AS play_time"), "k", "v")
def _(t: Timeline) -> Query:
    """How long the state was view with a value over 50."""
    return Query(t).metric("play_time", M.duration_true((t["k"] == "view") & (t["v"] > 50)))


_ALIVE = f"last_value(CASE WHEN k = 'click' THEN t END IGNORE NULLS) {{upto}} AS lc"


@policy(
    "cidr",
    chain(_ALIVE + ", lag(k) {w} = 'error' AS pe, t - lag(t, 1, t) {w} AS dt", f"lag(coalesce(lc, -{10**18})) {{w}} + {6 * HOUR} AS until, t - dt AS pt",
          "CASE WHEN pe THEN dt - greatest(0, least(t, until) - pt) ELSE 0 END AS part", "CAST(sum(part) {upto} AS BIGINT) AS m"),
    "k",
)
def _(t: Timeline) -> Query:
    """Time in error that no click of the last six hours explains."""
    seen = P.FilterBuilder(t["k"]).filter_values("click").build_clock_filter()
    recent = P.edge_latch(seen, t.const(True), "6h")
    return Query(t).metric("m", M.duration_true((t["k"] == "error") & ~recent))


@policy("first_attempt", chain("bool_or(k = 'purchase') {upto} AS any_", "any_ AND NOT coalesce(lag(any_) {w}, false) AS first, t - min(t) OVER (PARTITION BY user_id) AS d", "d AS m FROM s2 WHERE first"), "k")
def _(t: Timeline) -> Query:
    """Time from an entity's first event to its first purchase."""
    attempted = (t["k"] == "purchase").has_been_true()
    return Query(t, at_events=False, trigger=attempted).metric("m", M.duration_of_current_level(t.const(1)))


_SESSION = chain(
    "lag(t) {w} AS lt, " + _VIEW, _SID + ", " + _TRUE, "sid <> coalesce(lag(sid) {w}, 0) AS edge, d",
    f"CASE WHEN edge THEN lag(d, 1, 0) {{w}} + CASE WHEN pb THEN dt - least(dt, {12 * HOUR}) ELSE 0 END END AS unused, lag(d, 1, 0) {{w}} AS pd",
    "d - coalesce(last_value(CASE WHEN edge THEN d END IGNORE NULLS) {upto}, 0) AS life",
    "sid AS session_id, life AS life_session_view_time, CASE WHEN sid IS NOT DISTINCT FROM lag(sid) {w} THEN life - lag(life, 1, 0) {w} ELSE life END AS interval_view_time, CAST(count(*) OVER (PARTITION BY user_id, sid ORDER BY t, event_id) AS BIGINT) AS life_session_events",
)


@policy("session_metrics_split", _SESSION, "k", split=30)
@policy("session_metrics", _SESSION, "k")
def _(t: Timeline) -> Query:
    """View time and events in the running session (twelve hours without event end it), and since the last row."""
    _, session = P.session_ids(t["k"].clock(), "12h")
    clock = t["k"].clock()
    q = Query(t, reset=session).metric("session_id", session)
    q.metric("life_session_view_time", M.duration_true(t["k"] == "view").scoped(session), interval="interval_view_time")
    return q.metric("life_session_events", M.peek(clock).scoped(session))


# What runs as a fold, and operators of one's own.


def recursion(init: str, step: str, out: str = "m", extra: str = "") -> str:
    """A value per event, step from the one before ({s}) and this event; init stands before the first."""
    cols = "user_id, event_id, k, v, t"
    return f"""WITH RECURSIVE e AS (SELECT {cols}{extra}, row_number() {W} AS r FROM ({_BASE.format(ts="ts")})),
    m AS (SELECT e.*, {step.replace("{s}", init)} AS s FROM e WHERE r = 1 UNION ALL SELECT e.*, {step.replace("{s}", "m.s")} FROM m JOIN e ON e.user_id = m.user_id AND e.r = m.r + 1)
    SELECT user_id, event_id, s AS {out} FROM m"""


def _dfa(s: int, x: str) -> int:
    """view, any number of click and error by turns, purchase: the state, -1 once it failed, 9 when done; begun anew at view."""
    return 1 if x == "view" else {(1, "click"): 2, (2, "error"): 1, (1, "purchase"): 9}.get((s, x), -1)


_DFA = "CASE WHEN e.k = 'view' THEN 1 WHEN {s} = 1 AND e.k = 'click' THEN 2 WHEN {s} = 2 AND e.k = 'error' THEN 1 WHEN {s} = 1 AND e.k = 'purchase' THEN 9 ELSE -1 END"
query("state_machine_dfa", recursion("0", _DFA, "state"), "k")(lambda t: {"state": P.StateMachineBuilder(t["k"].clock(), t["k"]).init_state(0).transition_fn(_dfa).build()})
query("state_machine_finite", recursion("0", _DFA, "state"), "k")(
    lambda t: {"state": P.StateMachineBuilder(t["k"].clock(), t["k"]).init_state(0).transition_fn(_dfa).finite((0, 1, 2, 9, -1), TYPES, 1 << 10)}
)
_SUM = "CAST((CASE WHEN e.edge THEN 5 ELSE {s} END * 3 + length(e.k)) % 1000 AS INT)"
query("state_machine_scoped", recursion("5", _SUM, extra=", starts_with(k, 's') <> lag(starts_with(k, 's'), 1, false) " + W + " AS edge"), "k")(
    lambda t: {"m": P.StateMachineBuilder(t["k"].clock(), t["k"]).init_state(5).transition_fn(lambda s, x: (s * 3 + len(x)) % 1000).scoped(t["k"].starts_with("s")).build()}
)
query("state_machine_saturating", chain(_EDGE, _RUN, "least(1 + count(*) OVER (PARTITION BY user_id, run ORDER BY t, event_id), 4) AS m"), "k")(
    lambda t: {"m": (P.StateMachineBuilder(t["k"].clock(), t["k"]).init_state(1).scoped(t["k"].starts_with("s")).saturating(4), "bigint")}
)


def latch_with_timers(ttl: int, others: str = "") -> str:
    """The level latch with a duration, moment by moment: q holds the times at which moments are due. others: further times."""
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, t, k = 'view' AS c, v, row_number() {W} AS r FROM ({_BASE.format(ts="ts")})),
    m AS (SELECT user_id, event_id, r, t, c, v, true AS ext, CASE WHEN c THEN v ELSE 0.0 END AS held, CASE WHEN c THEN t + {ttl} END AS until, CASE WHEN c THEN [t + {ttl}] ELSE CAST([] AS BIGINT[]) END AS q FROM e WHERE r = 1
      UNION ALL SELECT user_id, CASE WHEN ext THEN x_id END, r + ext::INT, nt, c, v, ext, CASE WHEN c THEN v WHEN nt >= until THEN 0.0 ELSE held END,
        CASE WHEN c THEN nt + {ttl} WHEN nt >= until THEN NULL ELSE until END, CASE WHEN c THEN list_append(q, nt + {ttl}) ELSE q END
      FROM (SELECT m.user_id, e.event_id AS x_id, m.r, least(coalesce(m.q[1], e.t), e.t) AS nt, e.t <= coalesce(m.q[1], e.t) AS ext,
              CASE WHEN e.t <= coalesce(m.q[1], e.t) THEN e.c ELSE m.c END AS c, CASE WHEN e.t <= coalesce(m.q[1], e.t) THEN e.v ELSE m.v END AS v, m.held, m.until,
              CASE WHEN m.q[1] <= e.t THEN m.q[2:] ELSE m.q END AS q
            FROM m JOIN e ON e.user_id = m.user_id AND e.r = m.r + 1))
    SELECT user_id, event_id, held AS m FROM m WHERE ext"""


query("level_latch_ttl_exact", latch_with_timers(6 * HOUR), "k", "v")(lambda t: {"m": P.level_latch(t["k"] == "view", t["v"], "6h", "double")})
query(
    "generator",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, t // {50 * HOUR} - min(t) OVER (PARTITION BY user_id) // {50 * HOUR} + 1 AS n FROM ({_BASE.format(ts="ts")})),
    g AS (SELECT 1 AS n, CAST(3 AS BIGINT) AS x UNION ALL SELECT n + 1, (5 * x + 3) % 97 FROM g WHERE n < (SELECT max(n) FROM e)) SELECT user_id, event_id, x AS m FROM e JOIN g USING (n)""",
    "k",
)(lambda t: {"m": P.generator(t, lambda s, ts: ((5 * s + 3) % 97, (5 * s + 3) % 97, 50 * HOUR - ts % (50 * HOUR)), 0, "bigint")})
query("custom_fold", recursion("0", "CAST({s} // 2 + floor(e.v) AS BIGINT)"), "v")(lambda t: {"m": t.custom(lambda s, ts, v: (s // 2 + int(v // 1),) * 2, t["v"], init=0, kind="bigint", default=0)})
query("custom_window", chain("max(v) {upto} - min(v) {upto} AS m"), "v")(lambda t: {"m": t.window(lambda w, x: F.max(x).over(w) - F.min(x).over(w), t["v"], default=0.0)})


def _squared(c: Column) -> Column:
    return F.pandas_udf(lambda x: x * x, "double")(c)


query("custom_map", chain("v * v AS m"), "v")(lambda t: {"m": t["v"].map(_squared, 0.0)})
query("has_changed", chain("starts_with(k, 's') AS b", "bool_or(b <> lag_b) {upto} AS m FROM (SELECT *, lag(b, 1, false) {w} AS lag_b FROM s1)"), "k")(lambda t: {"m": t["k"].starts_with("s").has_changed()})
query("fold_init", chain("round(100 + sum(v) {upto}, 4) AS m, least(min(v) {upto}, 20) AS n, greatest(max(v) {upto}, 95) AS o"), "k", "v")(
    lambda t: {n: P.state_fold(f, t["v"], t["k"].clock(), None, i).map(lambda c: F.round(c, 4), 0.0) for n, f, i in (("m", "SUM", 100.0), ("n", "MIN", 20.0), ("o", "MAX", 95.0))}
)
query("annotate_type", chain("CAST(floor(v) AS BIGINT) AS m, CAST(count(*) {upto} AS DOUBLE) AS n"), "v")(lambda t: {"m": t["v"].map(F.floor, 0).cast("bigint"), "n": t.event_clock().cast("double")})
query("measure_after_timer", chain(_VIEW, _TRUE, f"d + 0 AS m, (t // {5 * HOUR}) % 2 = 1 AS n"), "k")(lambda t: {"m": M.duration_true(t["k"] == "view"), "n": P.square_wave(t, "5h")})


@policy(
    "periodic_measure_scoped",
    "WITH e AS (" + chain(_VIEW, _TRUE, "t, k, d", key="user_id, ") + f"""), b AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM e GROUP BY user_id),
    g AS (SELECT user_id, unnest(generate_series(t0 + {24 * HOUR}, t1, {24 * HOUR})) AS t FROM b), h AS (SELECT g.user_id, g.t FROM g JOIN b USING (user_id) WHERE g.t < b.t1),
    x AS (SELECT h.user_id, h.t AS "at", e.d + CASE WHEN e.k = 'view' THEN h.t - e.t ELSE 0 END AS m, CASE WHEN h.t < c.t + {6 * HOUR} THEN c.v ELSE 0 END AS n
      FROM h ASOF JOIN e ON h.user_id = e.user_id AND h.t >= e.t ASOF JOIN (SELECT * FROM ({chain(_CHG, "t, v, chg", key="user_id, ")}) WHERE chg) c ON h.user_id = c.user_id AND h.t >= c.t)
    SELECT user_id, x."at", m, n, m - lag(m, 1, 0) OVER (PARTITION BY user_id ORDER BY x."at") AS i FROM x""",
    "k", "v", ts="at", events_=False,
)
def _(t: Timeline) -> Query:
    """Two operators with moments of their own, declared before and after the measurement of all."""
    q = Query(t, at_events=False).metric("m", M.duration_true(t["k"] == "view"), interval="i").every("24h")
    return q.metric("n", P.edge_latch(t["k"], t["v"], "6h"))


def _drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.sources.events import to_json_lines

    t = timeline(spark, sf_dir, "k")
    return to_json_lines(Query(t).metric("m", t["k"].count_changes()).metric("k", t["k"]).run("user_id", None, {"event_id": "event_id"}))


QUERIES["drain_json"] = _drain
ORACLES["drain_json"] = "SELECT CAST(to_json({'user_id': user_id, 'event_id': event_id, 'm': m, 'k': k}) AS VARCHAR) AS value FROM (" + chain(_CHG, "CAST(sum(chg::INT) {upto} AS BIGINT) AS m, k") + ")"
