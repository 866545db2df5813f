"""Syntax tree to text that parses to the same tree."""

from __future__ import annotations

from functools import singledispatch

from . import nodes as n
from .lexer import UNITS
from .parser import STRENGTH

_PLAIN = {"contains_not": "NOT CONTAINS", "not_in": "NOT IN", "contains": "CONTAINS", "in": "IN", "and": "AND", "or": "OR", "outside": "OUTSIDE", "intersects": "INTERSECTS", "contains_all": "CONTAINSALL", "contains_any": "CONTAINSANY", "contains_none": "CONTAINSNONE", "all_inside": "ALLINSIDE", "any_inside": "ANYINSIDE", "none_inside": "NONEINSIDE"}


def quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def duration(ms: int) -> str:
    out = ""
    for unit in ("y", "w", "d", "h", "m", "s", "ms"):
        k, ms = divmod(ms, UNITS[unit])
        out += f"{k}{unit}" if k else ""
    return out or "0s"


@singledispatch
def render(e) -> str:
    raise TypeError(type(e).__name__)


@render.register
def _(e: n.Literal):
    v = e.value
    if e.kind == "duration":
        return duration(v)
    if e.kind in ("datetime", "uuid", "bytes"):
        return e.kind[0] + quoted(v)
    if e.kind == "decimal":
        return f"{v}dec"
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else quoted(v) if isinstance(v, str) else str(v)


@render.register
def _(e: n.Name):
    return f"`{e.name}`" if e.quoted else e.name


@render.register
def _(e: n.Param):
    return f"${e.name}"


@render.register
def _(e: n.Record):
    key = e.key
    return f"{e.table}:" + (key.value if isinstance(key, n.Literal) and isinstance(key.value, str) and key.value.isidentifier() else render(key))


@render.register
def _(e: n.Field):
    return f"{render(e.base)}.{e.name}"


@render.register
def _(e: n.Item):
    return f"{render(e.base)}[{render(e.index)}]"


@render.register
def _(e: n.Every):
    return f"{render(e.base)}[WHERE {render(e.where)}]" if e.where else f"{render(e.base)}[*]"


@render.register
def _(e: n.Hop):
    return (render(e.base) if e.base else "") + "".join(way + name for way, name in e.steps)


@render.register
def _(e: n.Call):
    return f"{e.name}({', '.join(map(render, e.args))})"


@render.register
def _(e: n.Over):
    parts = [f"PARTITION BY {', '.join(map(render, e.partition))}"] if e.partition else []
    parts += [f"ORDER BY {', '.join(render(x) + ' DESC' * down for x, down in e.order)}"] if e.order else []
    if e.frame:
        end = lambda k, way: f"UNBOUNDED {way}" if k is None else "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
        parts.append(f"ROWS BETWEEN {end(e.frame[0], 'PRECEDING')} AND {end(e.frame[1], 'FOLLOWING')}")
    return f"{render(e.call)} OVER ({' '.join(parts)})"


@render.register
def _(e: n.Unary):
    return {"not": "!"}.get(e.op, e.op) + _inner(e.value, 9)


def _inner(e: n.Expr, power: int) -> str:
    weak = isinstance(e, (n.Binary, n.Span)) and STRENGTH[e.op] <= power
    return f"({render(e)})" if weak else render(e)


@render.register
def _(e: n.Binary):
    p = STRENGTH[e.op]
    return f"{_inner(e.left, p if e.op == '**' else p - 1)} {_PLAIN.get(e.op, e.op)} {_inner(e.right, p - 1 if e.op == '**' else p)}"


@render.register
def _(e: n.Span):
    return f"{_inner(e.start, 5)}{e.op}{_inner(e.end, 5)}"


@render.register
def _(e: n.Cast):
    return f"<{e.kind}> {_inner(e.value, 9)}"


@render.register
def _(e: n.ArrayOf):
    body = ", ".join(map(render, e.items))
    return f"{{{body}}}" if e.is_set else f"[{body}]"


@render.register
def _(e: n.ObjectOf):
    return "{" + ", ".join(f"{k if k.isidentifier() else quoted(k)}: {render(v)}" for k, v in e.items) + "}"


@render.register
def _(e: n.Query):
    return f"({render(e.select)})"


@render.register
def _(e: n.Block):
    if len(e.body) == 1 and not isinstance(e.body[0], n.Evaluate):
        return render(e.body[0])
    return "{" + "; ".join(map(render, e.body)) + "}"


@render.register
def _(e: n.Branch):
    cases = " ELSE ".join(f"IF {render(w)} THEN {render(t)}" for w, t in e.when)
    return cases + (f" ELSE {render(e.otherwise)}" if e.otherwise else "") + " END"


# ---------------------------------------------------------------- statements
@render.register
def _(s: n.Evaluate):
    return render(s.expr)


@render.register
def _(t: n.Target):
    if t.query is not None:
        return f"({render(t.query)})"
    if t.expr is not None:
        return render(t.expr)
    name = t.table if t.table.isidentifier() else quoted(t.table)
    return (f"{t.db}." if t.db else "") + (render(n.Record(name, t.key)) if t.key is not None else name)


@render.register
def _(s: n.Output):
    return "*" if s.expr is None else render(s.expr) + (f" AS {s.alias}" if s.alias else "")


@render.register
def _(s: n.Select):
    out = "SELECT " + "VALUE " * s.value + "DISTINCT " * s.distinct + ", ".join(map(render, s.fields))
    if s.target:
        out += " FROM " + "ONLY " * s.only + render(s.target) + (f" {s.alias}" if s.alias else "")
    if s.version:
        way, what, v = s.version
        out += f" {way} ({what} => {render(v)})"
    for j in s.joins:
        out += ("" if j.how == "inner" else f" {j.how.upper()}") + f" JOIN {render(j.target)}" + (f" {j.alias}" if j.alias else "") + f" ON {render(j.left)} = {render(j.right)}"
    if s.where:
        out += f" WHERE {render(s.where)}"
    if s.order:
        out += " ORDER BY " + ", ".join(render(e) + " DESC" * d for e, d in s.order)
    if s.group is not None:
        out += " GROUP BY " + (", ".join(map(render, s.group)) or "ALL")
    if s.having:
        out += f" HAVING {render(s.having)}"
    if s.limit:
        out += f" LIMIT {render(s.limit)}"
    if s.start:
        out += f" START {render(s.start)}"
    if s.fetch:
        out += " FETCH " + ", ".join(map(render, s.fetch))
    return out


@render.register
def _(s: n.Combine):
    return f"{render(s.left)} {s.op.upper()} {render(s.right)}"


def _returns(r) -> str:
    return "" if r is None else f" RETURN {r if isinstance(r, str) else render(r)}"


def _sets(sets) -> str:
    return " SET " + ", ".join(f"{k} = {render(v)}" for k, v in sets) if sets else ""


@render.register
def _(s: n.Change):
    out = s.op + (" IGNORE" if s.ignore else "") + (" INTO" if s.op == "INSERT" else "") + f" {render(s.target)}"
    if s.mode == "ROWS":
        out += f" {render(s.data)}"
    elif s.data:
        out += f" {s.mode} {render(s.data)}"
    out += _sets(s.sets)
    if s.where:
        out += f" WHERE {render(s.where)}"
    return out + _returns(s.returns)


@render.register
def _(s: n.Relate):
    return f"RELATE {render(s.source)}->{s.kind}->{render(s.target)}" + _sets(s.sets) + (f" CONTENT {render(s.data)}" if s.data else "")


def _column(name: str, opts) -> str:
    o, out = dict(opts), name
    out += f" {o['type']}" + " PRIMARY KEY" * ("primary" in o) + " NOT NULL" * ("required" in o) + " UNIQUE" * ("unique" in o)
    out += f" DEFAULT {render(o['default'])}" if "default" in o else ""
    out += f" CHECK ({render(o['assert'])})" if "assert" in o else ""
    return out + (f" REFERENCES {o['references']}" if "references" in o else "")


@render.register
def _(s: n.Define):
    g, verb = s.get, s.verb
    out = f"{verb} {'DATABASE LINK' if s.what == 'link' else s.what.upper()} {s.name if s.what == 'field' or s.name.isidentifier() else quoted(s.name)}"
    on = f" ON TABLE {g('table')}" if g("table") else ""
    if s.what == "table":
        if g("changes"):
            return out + " " + ", ".join("DROP COLUMN " + name if w == "drop" else f"{w.upper()} COLUMN {_column(name, o)}" for w, name, o in g("changes"))
        if g("columns"):
            out += " (" + ", ".join(_column(*c) for c in g("columns")) + ")" + ("" if g("schemafull") is None else f" WITH (SCHEMA = '{'STRICT' if g('schemafull') else 'FLEXIBLE'}')")
        else:
            out += " DROP" * bool(g("drop")) + ("" if g("schemafull") is None else " SCHEMAFULL" if g("schemafull") else " SCHEMALESS")
        return out + (" PERMISSIONS " + " ".join(f"FOR {a} WHERE {render(r)}" for a, r in g("permissions")) if g("permissions") else "")
    if s.what == "field":
        out += on + (f" TYPE {g('type')}" if g("type") else "") + (f" ASSERT {render(g('assert'))}" if g("assert") else "") + " READONLY" * bool(g("readonly"))
        for key in ("value", "default"):
            out += f" {key.upper()} {render(g(key))}" if g(key) else ""
        return out + (f" REFERENCES {g('references')}" if g("references") else "")
    if s.what == "index":
        kind = g("kind")
        out += on + " COLUMNS " + ", ".join(g("columns")) + (f" SEARCH ANALYZER {g('analyzer')}" if kind == "search" else "" if kind == "plain" else f" {kind.upper()}")
        if kind == "hnsw":
            out += f" DIMENSION {g('dimension')} DIST {g('dist')}" + "".join(f" {k.upper()} {g(k)}" for k in ("m", "efc", "efs") if g(k))
        return out
    if s.what == "analyzer":
        words = g("stopwords")
        return out + " LOWERCASE" * bool(g("lowercase")) + (" STOPWORDS " + ", ".join(map(quoted, words)) if words else "") + " STEMMING" * bool(g("stemming"))
    if s.what == "event":
        return out + on + f" WHEN {render(g('when'))} THEN ({'; '.join(map(render, g('then')))})"
    if s.what == "data rule":
        return out + f" APPLY {render(g('where'))}" + (" MASK " + ", ".join(map(quoted, g("mask"))) if g("mask") else "")
    if s.what == "link":
        more = [f"{k} {quoted(v)}" for k, v in s.options if k != "url"]
        return out + f" CONNECT BY {quoted(g('url'))}" + (" WITH " + " ".join(more) if more else "")
    return out + (f" {g('text')}" if g("text") else "")


@render.register
def _(s: n.Drop):
    return f"DROP {'DATABASE LINK' if s.what == 'link' else s.what.upper()} {s.name if '.' in s.name or s.name.isidentifier() else quoted(s.name)}" + (f" ON TABLE {s.table}" if s.table else "")


@render.register
def _(s: n.Info):
    return f"DESCRIBE {s.name}" if s.what == "describe" else "SHOW DATA RULES" if s.what == "data rules" else f"INFO FOR {s.what.upper()}" + (f" {s.name}" if s.name else "")


@render.register
def _(s: n.Explain):
    return "EXPLAIN " + "ANALYZE " * s.analyze + render(s.select)


@render.register
def _(s: n.Live):
    return f"LIVE {render(s.select)}" + " DIFF" * s.diff


@render.register
def _(s: n.Control):
    if s.op == "LET":
        return f"LET ${s.name} = {render(s.value)}"
    if s.op == "USE":
        return "USE " + " ".join(f"{k.upper()} {v}" for k, v in s.extra)
    if s.op == "ROLLBACK":
        return f"ROLLBACK TO {s.name}"
    return s.op + (f" {s.name}" if s.name else "") + (f" {render(s.value)}" if s.value else "")
