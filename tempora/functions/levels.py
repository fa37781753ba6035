"""Column functions over the moments of one entity: levels, clocks, changes.

A moment frame has the columns KEY, TS (BIGINT nanoseconds), SEQ, EXT (whether
an event, not the engine itself, made the moment). All windows share one
partitioning and one order, so that Spark plans one exchange and one sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TS, SEQ, EXT = "_key", "_ts", "_seq", "_ext"
#: The time of the moment after.
FOLLOW = "_follow"
UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def duration(value: int | str) -> int:
    """Nanoseconds of an integer or of a number with a unit; -1 is forever."""
    if isinstance(value, int):
        return value
    for unit in sorted(UNITS, key=len, reverse=True):
        number = value[: -len(unit)].strip()
        if value.endswith(unit) and number.lstrip("-").isdigit():
            return int(number) * UNITS[unit]
    raise ValueError(f"no duration: {value!r}")


def moments() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TS, SEQ)


def so_far() -> WindowSpec:
    return moments().rowsBetween(Window.unboundedPreceding, 0)


def held(x: Column, default: object) -> Column:
    """The last value that was assigned."""
    return F.coalesce(F.last(x, ignorenulls=True).over(so_far()), lit(default))


def clock(x: Column) -> Column:
    """How often x was assigned."""
    return F.count(x).over(so_far())


def prev(x: Column, default: object) -> Column:
    return F.lag(x, 1).over(moments()) if default is None else F.coalesce(F.lag(x, 1).over(moments()), lit(default))


def changed(x: Column, default: object) -> Column:
    """Whether x differs from the moment before; the first moment is held against the type's default."""
    return ~x.eqNullSafe(prev(x, default))


def nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def parsed(text: str, kind: str, default: object) -> object:
    """parse() of a plain value."""
    if kind == "boolean":
        return {"true": True, "false": False}.get(text, default)
    real = kind in ("double", "float")
    if not re.fullmatch(r"[+-]?[0-9.eE+-]+" if real else r"[+-]?[0-9]+", text):
        return default
    try:
        number = float(text) if real else int(text)
    except ValueError:
        return default
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}.get(kind)
    return number if bits is None or -(1 << bits - 1) <= number < 1 << bits - 1 else default


def parse(text: Column, kind: str, default: object) -> Column:
    """text as a number or the default; unlike a bare cast it takes no blanks around it."""
    tidy = text.rlike(r"^[+-]?[0-9.eE+-]+$") if kind in ("double", "float") else text.rlike(r"^[+-]?[0-9]+$")
    if kind == "boolean":
        tidy = text.isin("true", "false")
    return F.coalesce(F.when(tidy, text.try_cast(kind)), lit(default).cast(kind))


def lit(v: object) -> Column:
    """A literal; a tuple is a struct."""
    if isinstance(v, tuple):
        return F.struct(*[lit(x).alias(f"_{i}") for i, x in enumerate(v)])
    return v if isinstance(v, Column) else F.lit(v)
