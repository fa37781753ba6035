"""What a query consists of: a check before it runs, and its nodes as text or as a graph."""

from __future__ import annotations

from tempora.plans import nodes as N
from tempora.plans.policy import Query


def _title(n: N.Node) -> str:
    told = {k: v for k, v in vars(n).items() if k not in ("inputs", "timers", "default", "f", "py", "live", "against") and v not in (None, "", 0, False)}
    f = getattr(n, "f", None)
    name = getattr(f, "__name__", "") if f is not None else ""
    return type(n).__name__ + (f" {name}" if name and name != "<lambda>" else "") + "".join(f" {k}={v}" for k, v in told.items())


def describe(query: Query) -> str:
    """One line a node, inputs first: number, how deep in windows, what it is, inputs, timers; then what is read."""
    nodes, number = N.canonical(list(query.roots().values()))
    depth: list[int] = []
    lines = []
    for i, n in enumerate(nodes):
        own = [number[id(x)] for x in n.inputs]
        depth.append(max([depth[j] for j in own], default=0) + n.windowed)
        timers = "".join(f" +{t.offset}ns at {number[id(t.at)]}" if t.at is not None else f" every {t.period}ns" for t in n.timers)
        lines.append(f"{i:3} {'fold' if n.folded else depth[-1]} {_title(n)}" + (f" ({', '.join(map(str, own))})" if own else "") + (f" timers:{timers}" if timers else ""))
    reads = [f"{k} <- {number[id(r)]}" for k, r in query.roots().items()]
    return "\n".join(lines + reads)


def graph(query: Query) -> str:
    """The nodes in the DOT language; timers are dashed edges."""
    nodes, number = N.canonical(list(query.roots().values()))
    out = ["digraph query {", "  rankdir=LR;"]
    for i, n in enumerate(nodes):
        title = _title(n).replace('"', "'")
        out.append(f'  n{i} [label="{title}", shape={"box" if n.windowed else "ellipse"}];')
        out += [f"  n{number[id(x)]} -> n{i};" for x in n.inputs]
        out += [f"  n{number[id(t.at)]} -> n{i} [style=dashed];" for t in n.timers if t.at is not None]
    for k, r in query.roots().items():
        out += [f'  "{k}" [shape=plaintext];', f'  n{number[id(r)]} -> "{k}";']
    return "\n".join([*out, "}"])


def verify(query: Query) -> list[str]:
    """What is wrong with a query, in words; nothing if it can run. Types are checked by Spark's analyzer, without running a job."""
    wrong = []
    roots = query.roots()
    if not query.metrics:
        wrong.append("no metric")
    for n in N.ordered(list(roots.values())):
        if isinstance(n, N.Base) and not isinstance(n, N.Next) and n.name != "_clock" and n.name.removesuffix("__clock") not in query.line.fields:
            wrong.append(f"no field {n.name}")
        wrong += [f"a timer of {t.offset} ns" for t in n.timers if t.at is not None and t.offset <= 0]
        wrong += [f"a period of {t.period} ns" for t in n.timers if t.at is None and t.period <= 0]
    if query.periods and min(query.periods) <= 0:
        wrong.append("a measuring period that isn't positive")
    if not query.at_events and query.trigger is None and not query.periods:
        wrong.append("nothing is ever measured")
    if wrong:
        return wrong
    try:
        df, cols = query.line.lower(list(roots.values()))
        types = dict(df.select(*[c.alias(k) for k, c in zip(roots, cols, strict=True)]).dtypes)
    except Exception as e:  # the analyzer's own words
        return [str(e).splitlines()[0]]
    return [f"{k} isn't boolean but {types[k]}" for k in types if (k in ("filter", "trigger") or k.startswith("gate")) and types[k] != "boolean"]
