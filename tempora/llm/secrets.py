"""Secret scans with DataFrame functions only.

Base rules are regular expressions. Beside them, candidate strings (long runs of
hexadecimal or base64 characters) are scanned by a sliding window whose Shannon
entropy follows from character counts updated by one entering and one leaving
character; a window over its class's threshold marks the string, unless the
string is on the allow list or a base finding covers it.

Every pattern is only tried on texts that a cheap necessary pattern accepts.
Matches are located by extracting, in one pass anchored at the previous match,
each gap and the match behind it: start = lengths of all gaps and matches before.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "|".join(map(any_case, ("password", "passwd", "secret", "token")) ) + f"|{any_case('api')}_?{any_case('key')}"
_LEAD = f"(?:{_KEY})[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]"

#: (kind, pattern with the judged part as its only group, least length of that part, pattern that any kept match contains)
BASE = (
    ("assign", f"{_LEAD}({_VALUE}+)", 8, f"{_LEAD}{_VALUE}{{8}}"),
    ("access", "(AKIA[A-Z0-9]+)", 16, "AKIA[A-Z0-9]{12}"),
    ("hex", "([0-9a-f]+)", 32, "[0-9a-f]{32}"),
)


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are maximal runs of charset, at least window long, that contain all of needs."""

    kind: str
    charset: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...]


_HEX = "0123456789abcdefABCDEF"
_B64 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CLASSES = (
    EntropyClass("entropy_hex", "[0-9a-fA-F]", _HEX, 20, 2.9, ("[0-9]", "[a-fA-F]")),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_=-]", _B64, 24, 3.8, ("[0-9]", "[a-z]", "[A-Z]")),
)
#: Strings that look random and are no secrets, or say that they are made up.
ALLOW = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{6}|0123456789|abcdefgh"

#: Entropies are compared in integers, c * log2(c) to 2^-20 bits, so that updates are exact.
UNIT = 1 << 20
_SPAN = "struct<k:int,s:int,e:int>"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, kind: int, pattern: str, least: int, need: str) -> Column:
    """Spans of the leftmost non-overlapping matches whose group is long enough."""
    gap = _lit(f"\\G([\\s\\S]*?)(?:{pattern})")
    all_ = _lit(f"\\G([\\s\\S]*?{pattern})")
    return F.expr(f"""
    CASE WHEN {text} RLIKE {_lit(need)} THEN
      filter(aggregate(
        arrays_zip(regexp_extract_all({text}, {gap}, 1), regexp_extract_all({text}, {all_}, 1), regexp_extract_all({text}, {gap}, 2)),
        named_struct('at', 0, 'out', CAST(array() AS array<struct<k:int,s:int,e:int,n:int>>)),
        (a, x) -> named_struct('at', a.at + length(x.`1`),
                               'out', concat(a.out, array(named_struct('k', {kind}, 's', a.at + length(x.`0`), 'e', a.at + length(x.`1`), 'n', length(x.`2`)))))
      ).out, x -> x.n >= {least})
    ELSE CAST(array() AS array<struct<k:int,s:int,e:int,n:int>>) END""")


#: Counts of a window are packed into 64-bit numbers, so that an update touches few values whatever the alphabet.
COUNT_BITS = 5
PACKED = 60 // COUNT_BITS


def _hot(kind: int, c: EntropyClass, value: str) -> str:
    """The span, relative to value's start, from the first window over the threshold to the end of the last one; null without any.

    H = log2(W) - sum(c log2 c) / W, so H >= bits if the sum is at most W (log2(W) - bits).
    The value is turned to symbol numbers once, so the scan is linear in its length."""
    w = c.window
    if w >= 1 << COUNT_BITS:
        raise ValueError(f"windows of {w} characters; counts have {COUNT_BITS} bits")
    most = f"CAST(floor({w} * (log2({w}) - {c.bits}) * {UNIT}) AS BIGINT)"
    logs = [round(n * math.log2(n) * UNIT) if n > 1 else 0 for n in range(w + 2)]
    # what the sum gains when a count of n grows by one
    gain = "array(" + ", ".join(f"{b - a}L" for a, b in zip(logs, logs[1:], strict=False)) + ")"
    words = -(-len(c.alphabet) // PACKED)

    def count(x: str) -> str:
        return f"CAST(shiftright(element_at(a.n, CAST({x} div {PACKED} AS INT) + 1), {COUNT_BITS} * CAST({x} % {PACKED} AS INT)) & {(1 << COUNT_BITS) - 1} AS INT)"

    def moved(x: str, sign: str) -> str:
        return f"transform(a.n, (c, k) -> IF(k = {x} div {PACKED}, c {sign} shiftleft(1L, {COUNT_BITS} * CAST({x} % {PACKED} AS INT)), c))"

    return f"""
    transform(array(transform(split({value}, ''), h -> instr({_lit(c.alphabet)}, h) - 1)), xs ->
    aggregate(sequence(1, size(xs)),
      named_struct('n', array_repeat(0L, {words}), 'sum', 0L, 'lo', CAST(NULL AS INT), 'hi', CAST(NULL AS INT)),
      (a0, i) -> aggregate(array(1, 2, 3), a0,
        (a, phase) -> CASE phase
          WHEN 1 THEN IF(i <= {w}, a, named_struct('n', {moved(f'xs[i - {w + 1}]', '-')}, 'sum', a.sum - element_at({gain}, {count(f'xs[i - {w + 1}]')}), 'lo', a.lo, 'hi', a.hi))
          WHEN 2 THEN named_struct('n', {moved('xs[i - 1]', '+')}, 'sum', a.sum + element_at({gain}, {count('xs[i - 1]')} + 1), 'lo', a.lo, 'hi', a.hi)
          ELSE IF(i >= {w} AND a.sum <= {most}, named_struct('n', a.n, 'sum', a.sum, 'lo', coalesce(a.lo, i - {w}), 'hi', i), a) END),
      a -> IF(a.lo IS NULL, CAST(NULL AS {_SPAN}), named_struct('k', {kind}, 's', a.lo, 'e', a.hi))))[0]"""


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: str = ALLOW) -> DataFrame:
    """doc_id, base (array of spans), added (array of spans); a span is (kind number, start, end) in code points.

    Null and empty texts have no spans; null ids and repeated rows stay; columns
    other than the two named are left out, whatever they are called.
    """
    names = {f"_m{k}": _spans("t_text", k, p, n, need) for k, (_, p, n, need) in enumerate(BASE)}
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t_text"))
    for k, c in enumerate(classes, len(BASE)):
        names[f"_c{k}"] = _spans("t_text", k, f"({c.charset}{{{c.window},}})", c.window, f"{c.charset}{{{c.window}}}")
    df = df.withColumns(names)
    base = F.array_sort(F.concat(*[F.expr(f"transform(_m{k}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))") for k in range(len(BASE))]))
    df = df.withColumn("base", base)
    added = []
    for k, c in enumerate(classes, len(BASE)):
        value = "substring(t_text, x.s + 1, x.e - x.s)"
        needs = " AND ".join(f"x.v RLIKE {_lit(n)}" for n in c.needs)
        added.append(F.expr(f"""
          filter(transform(
            filter(transform(_c{k}, x -> named_struct('v', {value}, 's', x.s)), x -> {needs} AND NOT x.v RLIKE {_lit(allow)}),
            x -> transform(array({_hot(k, c, 'x.v')}), h -> named_struct('s', x.s + h.s, 'k', h.k, 'e', x.s + h.e))[0]),
            h -> h.s IS NOT NULL AND NOT exists(base, b -> b.s <= h.s AND h.e <= b.e))"""))
    return df.withColumn("added", F.array_sort(F.concat(*added))).select("doc_id", "base", "added")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """docs with each run of overlapping spans replaced by mark; every row and column stays.

    A text without spans, null included, is left as it is."""
    given = docs.columns
    plain = [f"c{i}" for i in range(len(given))]  # names that clash with nothing
    df = docs.toDF(*plain)
    text = plain[given.index(text_col)]
    found = scan(df.select(F.struct(*plain).alias("row"), F.col(text).alias("body")), "row", "body", classes)
    body = f"doc_id.{text}"
    merged = f"""
      aggregate(array_sort(concat(base, added)), named_struct('at', 0, 'out', ''),
        (a, x) -> IF(x.e <= a.at, a, named_struct('at', x.e, 'out', concat(a.out,
            IF(x.s < a.at, '', concat(substring({body}, a.at + 1, x.s - a.at), {_lit(mark)}))))),
        a -> concat(a.out, substring({body}, a.at + 1)))"""
    new = F.expr(f"CASE WHEN size(base) + size(added) = 0 THEN {body} ELSE {merged} END")
    return found.select(*[(new if p == text else F.col(f"doc_id.{p}")).alias(g) for p, g in zip(plain, given, strict=True)])


def _joined(spans: str, kinds: list[str]) -> str:
    names = "array(" + ", ".join(map(_lit, kinds)) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')"


def report(found: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    kinds = [k for k, *_ in BASE] + [c.kind for c in classes]
    count = {f"n_{k}": F.expr(f"CAST(size(filter(base, x -> x.k = {i})) AS BIGINT)") for i, k in enumerate(kinds[: len(BASE)])}
    return found.select(
        "doc_id", *[v.alias(k) for k, v in count.items()],
        F.expr(f"sha2({_joined('base', kinds)}, 256)").alias("base_sha256"),
        F.expr(_joined("array_sort(concat(base, added))", kinds)).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def oracle() -> str:
    """The same by other means: counts of every window afresh instead of updates."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    kinds = [k for k, *_ in BASE] + [c.kind for c in CLASSES]
    pats = [(p, n) for _, p, n, _ in BASE] + [(f"({c.charset}{{{c.window},}})", c.window) for c in CLASSES]
    needed = [need for *_, need in BASE] + [f"{c.charset}{{{c.window}}}" for c in CLASSES]
    cols = []
    for k, (p, _) in enumerate(pats):
        found = {"g": (f"(?s)(.*?)(?:{p})", 1), "m": (f"(?s)(.*?{p})", 1), "v": (f"(?s)(.*?)(?:{p})", 2)}
        cols += [f"CASE WHEN regexp_matches(t, {q(needed[k])}) THEN regexp_extract_all(t, {q(x)}, {g}) ELSE [] END AS {n}{k}" for n, (x, g) in found.items()]
    at = "coalesce(list_sum(list_transform(m{k}[1:i-1], y -> length(y))), 0)"
    spans = []
    for k, (_, n) in enumerate(pats):
        a = at.format(k=k)
        spans.append(f"list_filter(list_transform(range(1, len(m{k}) + 1), i -> {{'s': CAST({a} + length(g{k}[i]) AS INT), 'k': {k}, 'e': CAST({a} + length(m{k}[i]) AS INT), 'n': length(v{k}[i]), 'v': v{k}[i]}}), x -> x.n >= {n}) AS c{k}")
    base = "list_sort(flatten([" + ", ".join(f"list_transform(c{k}, x -> {{'s': x.s, 'k': x.k, 'e': x.e}})" for k in range(len(BASE))) + "]))"
    added = []
    for k, c in enumerate(CLASSES, len(BASE)):
        w = c.window
        most = f"CAST(floor({w} * (log2({w}) - {c.bits}) * {UNIT}) AS BIGINT)"
        total = f"list_sum(list_transform(map_values(list_aggregate(string_split(substr(x.v, i + 1, {w}), ''), 'histogram')), c -> CAST(round(c * log2(c) * {UNIT}) AS BIGINT)))"
        hot = f"list_filter(range(0, length(x.v) - {w} + 1), i -> {total} <= {most})"
        needs = " AND ".join(f"regexp_matches(x.v, {q(n)})" for n in c.needs)
        added.append(f"list_transform(list_filter(list_transform(list_filter(c{k}, x -> {needs} AND NOT regexp_matches(x.v, {q(ALLOW)})), x -> {{'s': x.s, 'h': {hot}}}), x -> len(x.h) > 0), x -> {{'s': CAST(x.s + x.h[1] AS INT), 'k': {k}, 'e': CAST(x.s + x.h[-1] + {w} AS INT)}})")
    name = "CASE x.k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    join = "coalesce(array_to_string(list_transform({}, x -> concat(" + name + ", ':', x.s, ':', x.e)), ','), '')"
    sql = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    a AS (SELECT doc_id, {', '.join(cols)} FROM d),
    b AS (SELECT doc_id, {', '.join(spans)} FROM a),
    c AS (SELECT *, {base} AS base, flatten([{', '.join(added)}]) AS more FROM b),
    e AS (SELECT doc_id, base, list_filter(more, h -> len(list_filter(base, b -> b.s <= h.s AND h.e <= b.e)) = 0) AS added FROM c)
    SELECT doc_id, {', '.join(f"CAST(len(list_filter(base, x -> x.k = {i})) AS BIGINT) AS n_{k}" for i, k in enumerate(kinds[:3]))},
           sha256({join.format('base')}) AS base_sha256,
           {join.format('list_sort(list_concat(base, added))')} AS spans
    FROM e"""
    return re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
