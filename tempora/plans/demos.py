"""Three suites of metrics over one event log each, as applications compose them: an application's sessions and
navigations, an experiment's outputs, and a video player's states. And three small ones.

The table events stands for the logs: what an event assigns follows from its type and number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import measurements as M
from tempora.operators import processors as P
from tempora.plans.policy import Query
from tempora.plans.suite import HOUR, chain
from tempora.plans.timeline import Field, Signal, Timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ALIVE, ACTIVE = 12 * HOUR, 6 * HOUR
CRITICAL = ("screen_view", "app_error")
#: field -> what an event assigns to it, in SQL that both engines know; k, v and n are its type, value and number.
PATCHES = {
    "event_name": "CASE k WHEN 'view' THEN 'screen_view' WHEN 'click' THEN 'video_event' WHEN 'error' THEN 'app_error' WHEN 'purchase' THEN 'network_request' ELSE 'background' END",
    "video_event": "CASE WHEN k = 'click' THEN CASE n % 3 WHEN 0 THEN 'custom' WHEN 1 THEN 'attempt' ELSE 'play' END END",
    "platform": "CASE WHEN k = 'view' THEN CASE WHEN n % 2 = 0 THEN 'mob' ELSE 'web' END END",
    "page_id": "CASE WHEN k = 'view' THEN CAST(n % 4 AS VARCHAR(9)) END",
    "screen_id": "CASE WHEN k = 'click' THEN CAST(n % 2 AS VARCHAR(9)) END",
    "load_start": "CASE WHEN k = 'view' THEN CAST(n % 1000 AS VARCHAR(9)) END",
    "load_end": "CASE WHEN k = 'view' THEN CAST(n % 1000 + n % 131 - 20 AS VARCHAR(9)) END",
    "response_code": "CASE WHEN k = 'purchase' THEN CASE WHEN n % 3 = 0 THEN '404' ELSE '200' END END",
    "request_duration": "CASE WHEN k = 'purchase' THEN CAST(n % 300 - 30 AS VARCHAR(9)) END",
    "startup_start": "CASE WHEN k = 'view' AND n % 3 = 0 THEN CAST(n % 500 AS VARCHAR(9)) END",
    "startup_end": "CASE WHEN k = 'view' AND n % 3 = 0 THEN CAST(n % 500 + n % 97 - 9 AS VARCHAR(9)) END",
    "startup_previous": "CASE WHEN k = 'view' AND n % 6 = 0 THEN 'true' END",
    "encoded_fps": "CASE WHEN k = 'view' THEN v END",
    "rendered_fps": "CASE WHEN k = 'click' THEN v END",
    "currency": "CASE WHEN k = 'purchase' THEN CASE n % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'CNY' WHEN 2 THEN 'EURO' ELSE 'USD' END END",
    "session": "CASE WHEN k = 'signup' THEN CAST(n % 5 AS VARCHAR(9)) END",
    "player_state": "CASE WHEN k = 'view' THEN CASE n % 3 WHEN 0 THEN 'playing' WHEN 1 THEN 'buffering' ELSE 'pause' END END",
    "cdn": "CASE WHEN k = 'click' THEN CAST(n % 7 AS VARCHAR(9)) END",
    "bit_rate": "CASE WHEN k = 'click' THEN n % 9 END",
    "ev": "CASE WHEN k = 'error' THEN CASE WHEN n % 2 = 0 THEN 'seek start' ELSE 'seek end' END END",
}
APP = {n: Field("string", volatile=n.startswith("startup")) for n in list(PATCHES)[:12]}
EXPERIMENT = {n: APP[n] for n in ("event_name", "video_event", "page_id", "screen_id")} | {
    "encoded_fps": Field("double"), "rendered_fps": Field("double"), "currency": Field("string", values=("Unknown", "CNY", "EURO", "USD")),
}
VIDEO = {n: Field("string") for n in ("session", "player_state", "cdn", "ev")} | {"bit_rate": Field("int")}


def timeline(spark: SparkSession, sf_dir: str, fields: dict[str, Field], merge: bool = True) -> Timeline:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", F.col("event_type").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("n"))
    patched = raw.select("user_id", "event_id", "ts", *[F.expr(PATCHES[n]).alias(n) for n in fields])
    return Timeline.of(patched, "user_id", "ts", ["event_id"], fields, merge, ["event_id"])


def suite(name: str, oracle: str, fields: dict[str, Field], *used: str, merge: bool = True):
    """Register build(timeline) -> Query; used: the fields that are read, if not all."""

    def deco(build: Callable[[Timeline], Query]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(timeline(spark, sf_dir, {n: fields[n] for n in used or fields}, merge)).run("user_id", None, {"event_id": "event_id"})

        QUERIES[name], ORACLES[name] = run, oracle
        return build

    return deco


def _level(*names: str) -> str:
    return ", ".join(f"coalesce(last_value({PATCHES[n].replace('n %', 'event_id %')} IGNORE NULLS) {{upto}}, '') AS {n}" for n in names)


def _patch(*names: str) -> str:
    return ", ".join(f"{PATCHES[n].replace('n %', 'event_id %')} AS {n}" for n in names)


# The application: sessions live for twelve hours after each critical event; navigations change with session, page or screen.


def scopes(t: Timeline) -> tuple[Signal, Signal, Signal]:
    """(alive, session, navigation)"""
    plain = P.FilterBuilder(t["event_name"]).filter_values(*CRITICAL).build_clock_filter()
    custom = P.FilterBuilder(t["event_name"]).filter_values("video_event").then_filter(t["video_event"]).filter_values("custom").build_clock_filter()
    alive = P.make_tuple(plain, custom).has_changed(ALIVE)
    session = alive.count_changes()
    return alive, session, P.make_tuple(session, t["page_id"].count_changes(), t["screen_id"].count_changes()).count_changes()


#: The same in SQL. fell: the session ended between two events, fell_now: at this very event; row_nav: this event's moment begins a navigation.
_TICK = "(k IN ('view', 'error') OR (k = 'click' AND event_id % 3 = 0))"
SCOPES = (
    f"{_TICK} AS tick, lag(t) {{w}} AS pt, " + _level("page_id", "screen_id"),
    "max(CASE WHEN tick THEN t END) {upto} AS lt, max(CASE WHEN tick THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plt,"
    " page_id <> lag(page_id, 1, '') {w} OR screen_id <> lag(screen_id, 1, '') {w} AS moved",
    f"tick AND (plt IS NULL OR t - plt > {ALIVE}) AS begun, coalesce(t < lt + {ALIVE}, false) AS alive, plt IS NOT NULL AND coalesce(pt < plt + {ALIVE}, false) AND plt + {ALIVE} < t AS fell,"
    f" plt IS NOT NULL AND plt + {ALIVE} = t AND NOT tick AS fell_now",
    "CAST(2 * sum(begun::INT) {upto} - alive::INT AS BIGINT) AS session, begun OR fell_now OR moved AS row_nav",
    "CAST(sum(fell::INT + row_nav::INT) {upto} AS BIGINT) AS navigation",
)


@suite("app_scopes", chain(*SCOPES, "session AS session_id, navigation AS navigation_id, session <> lag(session, 1, 0) {w} AS is_session_start_interval, navigation <> lag(navigation, 1, 0) {w} AS is_navigation_switch_start_interval"), APP, "event_name", "video_event", "page_id", "screen_id")
def _(t: Timeline) -> Query:
    _, session, navigation = scopes(t)
    q, clock = Query(t).metric("session_id", session).metric("navigation_id", navigation), t["event_name"].clock()
    q.metric("is_session_start_interval", ~(session.prior_value(clock) == session))
    return q.metric("is_navigation_switch_start_interval", ~(navigation.prior_value(clock) == navigation))


def folded(clock: str, x: str, scope: str, how: str) -> str:
    """how of x at the rows of clock in the present scope's moments: a scope that changes at a row begins with it, one that ended before it, too."""
    return f"coalesce({how}(CASE WHEN {clock} THEN {x} END) OVER (PARTITION BY user_id, {scope} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0)"


_STARTUP = _patch("startup_start", "startup_end", "startup_previous")
_START_VALID = "ss > 0 AND se - ss > 0 AND se - ss < 300000 AND sp = ''"


def _summary(q: Query, scope: Signal, name: str, what: str, count: Signal, value: Signal, clock: Signal) -> Query:
    """Count, maximum and sum of a value at its clock's ticks in a scope."""
    q.metric(f"life_{name}_{what}_count", M.peek(count).scoped(scope))
    q.metric(f"life_{name}_max_{what}_duration", P.state_fold("MAX", value, clock, scope, 0))
    return q.metric(f"life_{name}_{what}_duration", P.state_fold("SUM", value, clock, scope), "bigint")


def _summary_sql(what: str, clock: str, value: str) -> str:
    parts = []
    for s in ("session", "navigation"):
        parts += [
            f"CAST(coalesce(count(CASE WHEN {clock} THEN 1 END) OVER (PARTITION BY user_id, {s} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS life_{s}_{what}_count",
            f"CAST({folded(clock, value, s, 'max')} AS INT) AS life_{s}_max_{what}_duration", f"CAST({folded(clock, value, s, 'sum')} AS BIGINT) AS life_{s}_{what}_duration",
        ]
    return ", ".join(parts)


@suite(
    "app_startup",
    chain(*SCOPES, f"CAST(coalesce({PATCHES['startup_start'].replace('n %', 'event_id %')}, '0') AS INT) AS ss, CAST(coalesce({PATCHES['startup_end'].replace('n %', 'event_id %')}, '0') AS INT) AS se, coalesce({PATCHES['startup_previous'].replace('n %', 'event_id %')}, '') AS sp",
          f"k = 'view' AND {_START_VALID} AS hit, se - ss AS x", _summary_sql("startup", "hit", "x")),
    APP, "event_name", "video_event", "page_id", "screen_id", "startup_start", "startup_end", "startup_previous",
)
def _(t: Timeline) -> Query:
    _, session, navigation = scopes(t)
    start, end = t["startup_start"].parse("int"), t["startup_end"].parse("int")
    length = end - start
    valid = (t["startup_previous"] == "") & (start > 0) & (length > 0) & (length < 300_000)
    took = P.if_(valid, length, t.const(-1))
    clock = P.FilterBuilder(t["event_name"]).filter_values("screen_view").then_filter(took > 0).build_clock_filter()
    q = Query(t)
    for name, scope in (("session", session), ("navigation", navigation)):
        _summary(q, scope, name, "startup", clock.count_changes(), took, clock)
    return q


_LOADS = (
    ", ".join(f"coalesce(try_cast(last_value({PATCHES[n].replace('n %', 'event_id %')} IGNORE NULLS) {{upto}} AS INT), 0) AS {a}" for n, a in (("load_start", "ls"), ("load_end", "le"))) + ", " + _level("platform"),
    "k = 'view' AND ls > 0 AND le - ls > 0 AND le - ls < CASE WHEN platform = 'mob' THEN 60000 ELSE 90000 END AS valid",
    "coalesce(last_value(CASE WHEN valid THEN ls END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps,"
    " coalesce(last_value(CASE WHEN valid THEN le END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pe",
    "valid AND (platform = 'mob' OR (ls > ps AND le > pe)) AS hit, le - ls AS x",
)


@suite("app_page_load", chain(*SCOPES, *_LOADS, _summary_sql("load", "hit", "x")), APP, "event_name", "video_event", "page_id", "screen_id", "platform", "load_start", "load_end")
def _(t: Timeline) -> Query:
    _, session, navigation = scopes(t)
    start, end = t["load_start"].parse("int"), t["load_end"].parse("int")
    mobile, length = t["platform"] == "mob", end - start
    valid = (start > 0) & (length > 0) & (length < P.if_(mobile, t.const(60_000), t.const(90_000)))
    ticks = P.FilterBuilder(valid, t["load_start"].clock()).filter_true().build_clock_filter()
    later = (start > start.prior_value(ticks)) & (end > end.prior_value(ticks))
    took = P.cond((mobile, length), [(later, length)], t.const(-1))
    # only valid loads count: else a mobile view without a start would let through the tick of a load that was passed over before
    clock = P.FilterBuilder((took > 0) & valid, ticks).filter_true().build_clock_filter()
    q = Query(t)
    for name, scope in (("session", session), ("navigation", navigation)):
        _summary(q, scope, name, "load", clock.count_changes(), took, clock)
    return q


#: A filter's clock moves on to its upstream clock whenever its own predicate holds, also if another field made it hold.
_REQUESTS = (
    "count(*) {upto} AS c, " + _level("response_code") + f", coalesce(try_cast(last_value({PATCHES['request_duration'].replace('n %', 'event_id %')} IGNORE NULLS) {{upto}} AS INT), 0) AS x",
    "coalesce(last_value(CASE WHEN k = 'purchase' THEN c END IGNORE NULLS) {upto}, 0) AS c1, starts_with(response_code, '2') AS ok", "coalesce(last_value(CASE WHEN x > 0 THEN c1 END IGNORE NULLS) {upto}, 0) AS c2",
    "coalesce(last_value(CASE WHEN ok THEN c2 END IGNORE NULLS) {upto}, 0) AS c3, coalesce(last_value(CASE WHEN NOT ok THEN c2 END IGNORE NULLS) {upto}, 0) AS c4",
    "c3 <> lag(c3, 1, 0) {w} AS h1, c4 <> lag(c4, 1, 0) {w} AS h2",
)
_NETWORK = ", ".join(
    f"CAST(count(CASE WHEN {hit} THEN 1 END) {over} AS BIGINT) AS life_{s}_{w}_request_count, CAST(coalesce(sum(CASE WHEN {hit} THEN x END) {over}, 0) AS BIGINT) AS life_{s}_{w}_request_duration"
    for s in ("session", "navigation") for w, hit in (("success", "h1"), ("failure", "h2")) for over in [f"OVER (PARTITION BY user_id, {s} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"]
)


@suite("app_network", chain(*SCOPES, *_REQUESTS, _NETWORK), APP, "event_name", "video_event", "page_id", "screen_id", "response_code", "request_duration")
def _(t: Timeline) -> Query:
    _, session, navigation = scopes(t)
    took = t["request_duration"].parse("int")
    some = P.FilterBuilder(t["event_name"]).filter_values("network_request").then_filter(took > 0)
    well, q = t["response_code"].starts_with("2"), Query(t)
    for name, scope in (("session", session), ("navigation", navigation)):
        for what, ok in (("success", well), ("failure", ~well)):
            clock = some.then_filter(ok).build_clock_filter()
            q.metric(f"life_{name}_{what}_request_count", M.peek(clock.count_changes()).scoped(scope))
            q.metric(f"life_{name}_{what}_request_duration", P.state_fold("SUM", took, clock, scope), "bigint")
    return q


#: Time until the first attempt in any session so far: one moment of one attempt ends it for good, as the latch keeps it.
_ATTEMPT = (
    "k = 'click' AND event_id % 3 = 1 AS att", "least(count(CASE WHEN att THEN 1 END) OVER (PARTITION BY user_id, session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 2) AS a",
    "bool_or(a = 1) {upto} AS done", "CASE WHEN NOT coalesce(lag(done) {w}, true) THEN t - pt ELSE 0 END AS dt, NOT coalesce(lag(done) {w}, true) AS open",
    f"sum(dt) {{upto}} AS d", f"CASE WHEN begun OR fell_now THEN d WHEN fell THEN lag(d, 1, 0) {{w}} + CASE WHEN open THEN plt + {ALIVE} - pt ELSE 0 END END AS base",
    "d - coalesce(last_value(base IGNORE NULLS) {upto}, 0) AS life",
)


@suite(
    "app_first_attempt",
    chain(*SCOPES, *_ATTEMPT, "a AS video_attempt, a >= 1 AS life_session_has_first_attempted, a = 1 AS interval_has_first_attempted, CAST(life AS BIGINT) AS life_session_duration_before_first_attempt"),
    APP, "event_name", "video_event", "page_id", "screen_id",
)
def _(t: Timeline) -> Query:
    _, session, _ = scopes(t)
    return first_attempt(t, session, Query(t))


def first_attempt(t: Timeline, session: Signal, q: Query, interval: bool | None = None) -> Query:
    ticks = P.FilterBuilder(t["video_event"]).filter_values("attempt").build_clock_filter()
    attempt = P.StateMachineBuilder(ticks, t.const(1)).scoped(session).saturating(2)
    if interval is None:
        q.metric("video_attempt", attempt, "bigint").metric("life_session_has_first_attempted", attempt >= 1).metric("interval_has_first_attempted", attempt == 1)
    before = ~(attempt == 1).has_been_true()
    return q.metric("life_session_duration_before_first_attempt", M.duration_true(before).scoped(session), interval=interval)


_LIVE = (
    f"coalesce(lead(t) {{w}} < t + {ACTIVE}, false) AS live", "CASE WHEN coalesce(lag(live) {w}, false) THEN t - pt ELSE 0 END AS dt, coalesce(lag(live) {w}, false) AS plive", "sum(dt) {upto} AS d",
    f"lag(d, 1, 0) {{w}} + CASE WHEN plive THEN plt + {ALIVE} - pt ELSE 0 END AS gone",
    "last_value(CASE WHEN begun OR fell_now THEN d WHEN fell THEN gone END IGNORE NULLS) {upto} AS sb, last_value(CASE WHEN row_nav THEN d WHEN fell THEN gone END IGNORE NULLS) {upto} AS nb",
)


@suite("app_active_time", chain(*SCOPES, *_LIVE, "CAST(d - coalesce(sb, 0) AS BIGINT) AS life_session_user_active_time, CAST(d - coalesce(nb, 0) AS BIGINT) AS life_navigation_user_active_time"), APP, "event_name", "video_event", "page_id", "screen_id")
def _(t: Timeline) -> Query:
    _, session, navigation = scopes(t)
    active = P.liveness(t["event_name"].clock(), F.col("event_name").isNotNull(), ACTIVE, lambda e: e["event_name"] is not None)
    q = Query(t).metric("life_session_user_active_time", M.duration_true(active).scoped(session))
    return q.metric("life_navigation_user_active_time", M.duration_true(active).scoped(navigation))


# The experiment: outputs of every kind, let out only while a session is alive, differences begun anew in each session.

_FPS = ", ".join(f"coalesce(last_value({PATCHES[n]} IGNORE NULLS) {{upto}}, 0.0) AS {n}" for n in ("encoded_fps", "rendered_fps"))
_FRAMES = (
    _FPS + f", coalesce(last_value({PATCHES['currency'].replace('n %', 'event_id %')} IGNORE NULLS) {{upto}}, 'Unknown') AS currency",
    "coalesce(lag(encoded_fps) {w} * (t - pt), 0) AS de, coalesce(lag(rendered_fps) {w} * (t - pt), 0) AS dr, lag(encoded_fps) {w} AS le, lag(rendered_fps) {w} AS lr",
    "sum(de) {upto} / 1e9 AS e, sum(dr) {upto} / 1e9 AS r",
    ", ".join(f"CASE WHEN begun OR fell_now THEN {a} WHEN fell THEN lag({a}, 1, 0) {{w}} + coalesce(l{a} * (plt + {ALIVE} - pt), 0) / 1e9 END AS b{a}" for a in "er") + f", CASE WHEN begun OR fell_now THEN t WHEN fell THEN plt + {ALIVE} END AS bt",
    "e - coalesce(last_value(be IGNORE NULLS) {upto}, 0) AS fe, r - coalesce(last_value(br IGNORE NULLS) {upto}, 0) AS fr, t - coalesce(last_value(bt IGNORE NULLS) {upto}, 0) AS life",
)
_EXPERIMENT = chain(
    *SCOPES, *_FRAMES, *_ATTEMPT[:-1], "d - coalesce(last_value(base IGNORE NULLS) {upto}, 0) AS before",
    "* FROM (SELECT *, CASE WHEN session = lag(session) {w} THEN life + 1 - lag(life + 1) {w} ELSE life + 1 END AS i1, CASE WHEN session = lag(session) {w} THEN before - lag(before) {w} ELSE before END AS i2 FROM {x} WHERE alive)",
    "strftime(make_timestamp(t // 1000), '%Y-%m-%d %H:%M:%S.%g') || ' UTC' AS ts, session AS session_id, navigation AS navigation_id, life + 1 AS life_session_ts_plus1, CAST(i1 AS BIGINT) AS interval_ts_plus1, life + 3 AS ts_plus1_plus2, CAST(2 AS BIGINT) AS diff,"
    " round(fe, 3) + 0.0 AS encoded_frames, round(fr, 3) + 0.0 AS rendered_frames, round(fe - fr, 3) + 0.0 AS dropped_frames, currency, currency = 'CNY' AS is_cny, currency <> 'Unknown' AS above_unknown,"
    " CAST(before AS BIGINT) AS life_session_duration_before_first_attempt, CAST(i2 AS BIGINT) AS interval_duration_before_first_attempt",
)


@suite("experiment_metrics", _EXPERIMENT, EXPERIMENT)
def _(t: Timeline) -> Query:
    alive, session, navigation = scopes(t)
    q = Query(t, gate=[alive], reset=session).metric("ts", M.formatted(M.peek_timestamp(t))).metric("session_id", session).metric("navigation_id", navigation)
    life = M.peek_timestamp(t).scoped(session)
    one = life.map(lambda x: x + 1)
    three = one.map(lambda x: x + 2)
    q.metric("life_session_ts_plus1", one, interval="interval_ts_plus1").metric("ts_plus1_plus2", three).metric("diff", one.combine(lambda x, y: y - x, three), "bigint")
    encoded, rendered = (M.linear_change(t[n]).scoped(session) for n in ("encoded_fps", "rendered_fps"))
    rounded = lambda c: F.round(c, 3) + 0.0
    q.metric("encoded_frames", encoded.map(rounded)).metric("rendered_frames", rendered.map(rounded))
    q.metric("dropped_frames", encoded.combine(lambda x, y: x - y, rendered).map(rounded))
    rank, unknown = t["currency"].rank(), 0
    q.metric("currency", t["currency"]).metric("is_cny", t["currency"] == "CNY").metric("above_unknown", rank > unknown)
    return first_attempt(t, session, q, interval=True)


# The video player: levels belong to the session in which they were assigned; simultaneous events aren't merged.

_VIDEO = (
    f"{PATCHES['session'].replace('n %', 'event_id %')} AS sa, lag(t) {{w}} AS pt, {PATCHES['ev'].replace('n %', 'event_id %')} AS eva, {_patch('player_state', 'cdn', 'bit_rate')}",
    "coalesce(last_value(sa IGNORE NULLS) {upto}, '') AS sl, coalesce(last_value(eva IGNORE NULLS) {upto}, '') AS ev, coalesce(last_value(player_state IGNORE NULLS) {upto}, '') AS p",
    "sl <> lag(sl, 1, '') {w} AS edge", "CAST(sum(edge::INT) {upto} AS BIGINT) AS sess",
    # a level counts if it was assigned at or after the session's first moment
    "coalesce(last_value(player_state IGNORE NULLS) OVER (PARTITION BY user_id, sess ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), '') AS ps, coalesce(last_value(cdn IGNORE NULLS) OVER (PARTITION BY user_id, sess ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), '') AS c,"
    " coalesce(last_value(bit_rate IGNORE NULLS) OVER (PARTITION BY user_id, sess ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), CASE WHEN sess = 0 THEN 0 ELSE -1 END) AS br,"
    " coalesce(bool_or(CASE WHEN sa IS NOT NULL THEN p = 'playing' END) OVER (PARTITION BY user_id, sess ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), false) AS been",
    "ps = 'buffering' AS b0, ps = 'buffering' AND NOT been AS b1, ps = 'buffering' AND been AS b2, ev = 'seek start' AS b3",
    ", ".join(f"sum(CASE WHEN lag_b{i} THEN t - pt ELSE 0 END) {{upto}} AS d{i}" for i in range(4)) + " FROM (SELECT *, " + ", ".join(f"lag(b{i}, 1, false) {{w}} AS lag_b{i}" for i in range(4)) + " FROM {x})",
    ", ".join(f"CAST(d{i} - coalesce(last_value(CASE WHEN edge THEN d{i} END IGNORE NULLS) {{upto}}, 0) AS BIGINT) AS {n}" for i, n in enumerate(("buffering_time", "initial_buffering_time", "rebuffering_time", "seek_time")))
    + ", ps AS player_state_now, c AS cdn_now, CAST(br AS INT) AS bitrate",
)


@suite("video_metrics", chain(*_VIDEO), VIDEO, merge=False)
def _(t: Timeline) -> Query:
    session = t["session"].count_changes()

    epoch = t["session"].clock()
    began = P.edge_latch(session, epoch)

    def own(field: str, default: object = None) -> Signal:
        return P.sessionized_by(t[field], began, P.edge_latch(t[field].clock(), epoch), default)

    state = own("player_state")
    q = Query(t).metric("player_state_now", state).metric("cdn_now", own("cdn")).metric("bitrate", own("bit_rate", -1))
    buffering = state == "buffering"
    been = P.state_fold("OR", t["player_state"] == "playing", t["session"].clock(), session)
    for name, s in (("buffering_time", buffering), ("initial_buffering_time", ~been & buffering), ("rebuffering_time", been & buffering), ("seek_time", t["ev"] == "seek start")):
        q.metric(name, M.duration_true(s).scoped(session))
    return q


# Small ones


@suite("event_count", chain("CAST(count(CASE WHEN k = 'error' THEN 1 END) {upto} AS BIGINT) AS errors"), APP, "event_name")
def _(t: Timeline) -> Query:
    return Query(t).metric("errors", P.FilterBuilder(t["event_name"]).filter_values("app_error").build_clock_filter().count_changes())


@suite("earliest_event", chain(f"first_value({PATCHES['event_name']}) {{upto}} AS earliest"), APP, "event_name")
def _(t: Timeline) -> Query:
    first = P.StateMachineBuilder(t["event_name"].clock(), t.const(1)).saturating(2) == 1
    return Query(t).metric("earliest", P.level_latch(first, t["event_name"]))


@suite(
    "player_times",
    chain(_level("video_event") + ", lag(t) {w} AS pt", "coalesce(last_value(CASE WHEN video_event IN ('custom', 'play') THEN video_event END IGNORE NULLS) {upto}, '') AS p, min(CASE WHEN video_event = 'attempt' AND k = 'click' THEN t END) {upto} AS ft",
          "sum(CASE WHEN lag_p = 'custom' THEN t - pt ELSE 0 END) {upto} AS d FROM (SELECT *, lag(p, 1, '') {w} AS lag_p FROM {x})", "coalesce(t - ft, 0) AS time_since_attempt, CAST(d AS BIGINT) AS buffering_time"),
    APP, "video_event",
)
def _(t: Timeline) -> Query:
    tried = P.FilterBuilder(t["video_event"]).filter_values("attempt").build_clock_filter()
    state = P.FilterBuilder(t["video_event"]).filter_values("custom", "play").build_value_filter()
    has = P.StateMachineBuilder(tried, t.const(1)).saturating(1) > 0
    return Query(t).metric("time_since_attempt", M.duration_since_true(has)).metric("buffering_time", M.duration_true(state == "custom"))
