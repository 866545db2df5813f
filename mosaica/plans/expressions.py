"""Expressions to typed Columns over a set of rows."""

from __future__ import annotations

import datetime as dt
import itertools
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import semantics as sem
from ..functions import FUNCTIONS, call, constant
from ..functions.types import cast
from ..lang import nodes as n
from ..lang.render import render
from ..semantics import Value, nothing

_hidden = itertools.count()


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def hidden() -> str:
    return f"__{next(_hidden)}"


class Unsupported(ValueError):
    pass


@dataclass
class Rows:
    """A DataFrame, the names by which expressions reach its columns, and what else they may refer to.

    ``labels`` maps a table name or alias to the prefix of its columns ("" where columns have none)."""

    df: DataFrame
    session: object = None
    labels: dict[str, str] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)
    special: dict[object, Value] = field(default_factory=dict)  # values of whole sub-expressions, by syntax tree
    id_column: str | None = None
    table: str | None = None
    score: Value | None = None
    terms: list[str] | None = None

    def visible(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def kind(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def find(self, name: str) -> Value | None:
        fields = self.df.columns
        if name in fields:
            return Value(col(name), self.kind(name))
        ends = [f for f in fields if f.endswith("." + name) and f.split(".", 1)[0] in self.labels]
        if len(ends) == 1:
            return Value(col(ends[0]), self.kind(ends[0]))
        if len(ends) > 1:
            raise Unsupported(f"{name} could be any of {', '.join(ends)}")
        low = [f for f in fields if f.lower() == name.lower()]
        return Value(col(low[0]), self.kind(low[0])) if low else None

    def qualified(self, label: str, name: str) -> Value | None:
        """A column of the table or alias, or None if it has no such label."""
        if label not in self.labels:
            return None
        full = self.labels[label] + name
        return Value(col(full), self.kind(full)) if full in self.df.columns else nothing()


def literal(v: object, kind: str = "plain") -> Value:
    if v is None:
        return nothing()
    if kind == "duration" or isinstance(v, dt.timedelta):
        ms = v if kind == "duration" else int(v.total_seconds() * 1000)
        return Value(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(Decimal(ms) / 1000).cast("decimal(18,6)")), T.DayTimeIntervalType(), True)
    if kind == "datetime":
        return Value(F.lit(str(v)).try_cast("timestamp"), T.TimestampType(), True)
    if kind == "bytes":
        return Value(F.lit(bytearray.fromhex(str(v))), T.BinaryType(), True)
    if isinstance(v, bool):
        return Value(F.lit(v), T.BooleanType(), True)
    if isinstance(v, int):
        return Value(F.lit(v).cast("long"), T.LongType(), True) if -(1 << 63) <= v < 1 << 63 else Value(F.lit(Decimal(v)), sem.WIDE, True)
    if isinstance(v, float):
        return Value(F.lit(v), T.DoubleType(), True)
    if isinstance(v, Decimal):
        return Value(F.lit(v).cast(sem.WIDE), sem.WIDE, True)
    if isinstance(v, dt.datetime):
        return Value(F.lit(v), T.TimestampType(), True)
    if isinstance(v, (bytes, bytearray)):
        return Value(F.lit(bytearray(v)), T.BinaryType(), True)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return array([literal(x) for x in v])
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return struct([(str(k), literal(x)) for k, x in v.items()])
    return Value(F.lit(str(v)), T.StringType(), True)


def common(kinds: list[T.DataType]) -> T.DataType:
    """The narrowest type that holds all of these; text where nothing else does."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)]
    if not kinds:
        return T.StringType()
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(sem.is_number(k) for k in kinds):
        if any(isinstance(k, (T.DoubleType, T.FloatType)) for k in kinds):
            return T.DoubleType()
        return sem.WIDE if any(isinstance(k, T.DecimalType) for k in kinds) else T.LongType()
    if all(isinstance(k, T.ArrayType) for k in kinds):
        return T.ArrayType(common([k.elementType for k in kinds]))
    if all(isinstance(k, T.StructType) for k in kinds):
        names = dict.fromkeys(f.name for k in kinds for f in k.fields)
        return T.StructType([T.StructField(x, common([k[x].dataType for k in kinds if x in k.fieldNames()])) for x in names])
    return T.StringType()


def conform(v: Value, kind: T.DataType) -> Column:
    """v in another type; fields that its struct lacks are NULL."""
    if v.kind == kind:
        return v.col
    if isinstance(kind, T.StructType) and isinstance(v.kind, T.StructType):
        own = v.kind.fieldNames()
        parts = [conform(Value(v.col.getField(f.name), v.kind[f.name].dataType), f.dataType).alias(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields]
        return F.when(v.col.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType) and v.array:
        return F.transform(v.col, lambda x: conform(Value(x, v.kind.elementType), kind.elementType))
    if isinstance(kind, T.StringType) and (v.array or v.object):
        return F.to_json(v.col)
    return v.col.cast(kind)


def array(items: list[Value]) -> Value:
    kind = common([x.kind for x in items])
    return Value(F.array(*(conform(x, kind) for x in items)) if items else F.array().cast(T.ArrayType(kind)), T.ArrayType(kind), all(x.literal for x in items))


def struct(items: list[tuple[str, Value]]) -> Value:
    if not items:
        return Value(F.create_map().cast("map<string,string>"), T.MapType(T.StringType(), T.StringType()))
    cast_ = [(k, v if not v.null else Value(F.lit(None).cast("string"), T.StringType())) for k, v in items]
    return Value(F.struct(*(v.col.alias(k) for k, v in cast_)), T.StructType([T.StructField(k, v.kind) for k, v in cast_]))


def _json_path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def member(base: Value, name: str) -> Value:
    """A field of an object, of each object of an array, or of JSON text."""
    if isinstance(base.kind, T.StructType):
        own = {f.name: f for f in base.kind.fields}
        return Value(base.col.getField(name), own[name].dataType) if name in own else nothing()
    if isinstance(base.kind, T.MapType):
        return Value(F.try_element_at(base.col, F.lit(name)), base.kind.valueType)
    if base.array and isinstance(base.kind.elementType, T.StructType):
        inner = base.kind.elementType
        return Value(base.col.getField(name), T.ArrayType(inner[name].dataType)) if name in inner.fieldNames() else nothing()
    if base.string:
        return Value(F.get_json_object(base.col, _json_path(name)), T.StringType())
    if isinstance(base.kind, T.VariantType):
        return Value(F.try_variant_get(base.col, "$." + name, "string"), T.StringType())
    return nothing()


def lower(e: n.Expr, rows: Rows) -> Value:
    """The value of an expression for each row."""
    if e in rows.special:
        return rows.special[e]
    return _LOWER[type(e)](e, rows)


def _name(e: n.Name, rows: Rows) -> Value:
    found = rows.find(e.name)
    if found is not None:
        return found
    made = None if e.quoted else constant(e.name)
    if made is not None:
        return made
    if e.name in rows.labels:
        return struct([(c, Value(col(rows.labels[e.name] + c), rows.kind(rows.labels[e.name] + c))) for c in rows.visible()]) if rows.labels[e.name] == "" else nothing()
    return nothing()


def _param(e: n.Param, rows: Rows) -> Value:
    if e.name in rows.params:
        v = rows.params[e.name]
        return v if isinstance(v, Value) else literal(v)
    v = rows.session.variable(e.name) if rows.session is not None else None
    if isinstance(v, DataFrame):
        return rows.session.array_of(v)
    return literal(v)


def _field(e: n.Field, rows: Rows) -> Value:
    if isinstance(e.base, n.Name):
        whole = rows.find(f"{e.base.name}.{e.name}")
        if whole is not None:
            return whole
        v = rows.qualified(e.base.name, e.name)
        if v is not None and rows.find(e.base.name) is None:
            return v
    base = lower(e.base, rows)
    if base.null and not isinstance(e.base, n.Param):
        # a base that is no field falls back to the row
        return rows.find(e.name) or nothing() if isinstance(e.base, n.Name) and rows.find(e.base.name) is None else nothing()
    return member(base, e.name)


def _item(e: n.Item, rows: Rows) -> Value:
    base, index = lower(e.base, rows), lower(e.index, rows)
    if base.array:
        k = index.col.cast("int")
        return Value(F.when(k >= 0, F.get(base.col, k)), base.kind.elementType)
    if isinstance(base.kind, T.MapType):
        return Value(F.try_element_at(base.col, index.col.cast("string")), base.kind.valueType)
    if isinstance(e.index, n.Literal) and isinstance(e.index.value, str):
        return member(base, e.index.value)
    if base.string:
        return Value(F.get_json_object(base.col, f"$[{e.index.value}]"), T.StringType()) if isinstance(e.index, n.Literal) else nothing()
    return nothing()


def _every(e: n.Every, rows: Rows) -> Value:
    base = lower(e.base, rows)
    if e.where is None or not base.array:
        return base
    return Value(F.filter(base.col, lambda x: sem.truthy(lower(e.where, _Inside(rows, Value(x, base.kind.elementType))))), base.kind)


class _Inside(Rows):
    """The rows with an item's fields before their own."""

    def __init__(self, rows: Rows, item: Value):
        super().__init__(rows.df, rows.session, rows.labels, {**rows.params, "this": item}, rows.special)
        self.item, self.outer = item, rows

    def find(self, name: str) -> Value | None:
        v = member(self.item, name) if isinstance(self.item.kind, T.StructType) else nothing()
        return v if not v.null else self.item if name == "value" else self.outer.find(name)


_BINARY = {
    "=": sem.eq, "==": lambda a, b: sem.eq(a, b, strict=True), "!=": sem.ne, "<": sem.lt, "<=": sem.le, ">": sem.gt, ">=": sem.ge,
    "+": sem.add, "-": sem.subtract, **{op: (lambda a, b, op=op: sem.arithmetic(op, a, b)) for op in "*/%"}, "**": sem.power,
    "contains": sem.holds, "contains_not": lambda a, b: sem.boolean(~sem.holds(a, b).col), "in": lambda a, b: sem.holds(b, a), "not_in": lambda a, b: sem.boolean(~sem.holds(b, a).col),
    "*=": sem.all_equal, "?=": sem.any_equal, "@@": sem.matches,
    **{f"contains_{how}": (lambda a, b, how=how: sem.holds_each(a, b, how)) for how in ("all", "any", "none")},
    **{f"{how}_inside": (lambda a, b, how=how: sem.holds_each(b, a, how)) for how in ("all", "any", "none")},
    "outside": lambda a, b: nothing(), "intersects": lambda a, b: nothing(), "?:": lambda a, b: nothing(),
}


def _binary(e: n.Binary, rows: Rows) -> Value:
    a, b = lower(e.left, rows), lower(e.right, rows)
    if e.op == "and":
        return sem.boolean(sem.truthy(a) & sem.truthy(b))
    if e.op == "or":
        return sem.boolean(sem.truthy(a) | sem.truthy(b))
    if e.op == "??":
        if a.null or b.null:
            return b if a.null else a
        kind = common([a.kind, b.kind])
        return Value(F.coalesce(conform(a, kind), conform(b, kind)), kind)
    return _BINARY[e.op](a, b)


def condition(e: n.Expr, rows: Rows) -> Column:
    """An expression as a filter: NULL need not become false there, which keeps push-down possible."""
    if isinstance(e, n.Binary) and e.op in ("and", "or"):
        a, b = condition(e.left, rows), condition(e.right, rows)
        return a & b if e.op == "and" else a | b
    return sem.condition(lower(e, rows))


def _unary(e: n.Unary, rows: Rows) -> Value:
    v = lower(e.value, rows)
    if e.op == "not":
        return sem.boolean(~sem.truthy(v))
    if e.op == "+":
        return v
    if isinstance(v.kind, T.DayTimeIntervalType):
        return Value(-v.col, v.kind)
    return sem.subtract(literal(0), v)


def _call(e: n.Call, rows: Rows) -> Value:
    name = e.name.lower()
    if name == "search::score":
        return rows.score or literal(0.0)
    if name == "search::highlight":
        from ..operators.fulltext import highlight

        args = [lower(a, rows) for a in e.args]
        return highlight(args[0], rows.terms or [], *args[1:])
    if name.startswith("kv::"):
        return rows.session.kv_call(name, [lower(a, rows) for a in e.args], rows)
    if name.startswith("graph::"):
        return rows.session.graph_call(name, e.args, rows)
    if name == "count" and len(e.args) == 1 and isinstance(e.args[0], n.Name) and e.args[0].name == "*":
        return literal(1)
    args = [lower(a, rows) for a in e.args]
    if name not in FUNCTIONS and args:  # value.method(...): the function of the value's kind
        v = args[0]
        family = "array" if v.array else "string" if v.string else "math" if v.number else "time" if isinstance(v.kind, sem.MOMENTS) else "object"
        if f"{family}::{name}" in FUNCTIONS:
            name = f"{family}::{name}"
    return call(name, args)


def _branch(e: n.Branch, rows: Rows) -> Value:
    parts = [(lower(w, rows), lower(t, rows)) for w, t in e.when]
    last = lower(e.otherwise, rows) if e.otherwise is not None else nothing()
    kind = common([t.kind for _, t in parts] + [last.kind])
    out = None
    for w, t in parts:
        out = (F.when if out is None else out.when)(sem.truthy(w), conform(t, kind))
    return Value(out.otherwise(conform(last, kind)) if not last.null else out, kind)


def _block(e: n.Block, rows: Rows) -> Value:
    """The last expression; bindings before it are in its scope."""
    inner = Rows(**{**rows.__dict__, "params": dict(rows.params)}) if type(rows) is Rows else rows
    out = nothing()
    for s in e.body:
        if isinstance(s, n.Control) and s.op == "LET":
            inner.params[s.name] = lower(s.value, inner)
        elif isinstance(s, n.Control) and s.op == "RETURN":
            return lower(s.value, inner)
        elif isinstance(s, n.Evaluate):
            out = lower(s.expr, inner)
        else:
            raise Unsupported(f"{render(s)} inside an expression")
    return out


def _query(e: n.Query, rows: Rows) -> Value:
    if rows.session is None:
        raise Unsupported("a subquery outside a session")
    return rows.session.subquery(e.select, rows)


def _hop(e: n.Hop, rows: Rows) -> Value:
    return rows.session.hop(e, rows)


def over(e: n.Over, rows: Rows) -> Value:
    """A ranking, offset or aggregate over a window. Missing values sort as in ORDER BY."""
    name, args = e.call.name.lower(), [lower(a, rows) for a in e.call.args]
    window = Window.partitionBy(*(lower(p, rows).col for p in e.partition)).orderBy(*(k for x, down in e.order for k in sem.sort_key(lower(x, rows), down)))
    if e.frame:
        window = window.rowsBetween(Window.unboundedPreceding if e.frame[0] is None else e.frame[0], Window.unboundedFollowing if e.frame[1] is None else e.frame[1])
    fixed = lambda k, default: int(e.call.args[k].value) if len(e.call.args) > k and isinstance(e.call.args[k], n.Literal) else default
    ranks = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
    if name in ranks:
        return Value(ranks[name]().over(window).cast("double" if name in ("percent_rank", "cume_dist") else "long"), T.DoubleType() if name in ("percent_rank", "cume_dist") else T.LongType())
    if name == "ntile":
        return Value(F.ntile(fixed(0, 1)).over(window).cast("long"), T.LongType())
    if name == "count":
        return Value(F.count(F.lit(1)).over(window), T.LongType())
    if name in ("lag", "lead") and args:
        return Value((F.lag if name == "lag" else F.lead)(args[0].col, fixed(1, 1)).over(window), args[0].kind)
    if name in ("first", "last", "min", "max") and len(args) == 1:
        return Value(getattr(F, name)(args[0].col).over(window), args[0].kind)
    if name in ("sum", "avg") and len(args) == 1 and args[0].number:
        made, whole = getattr(F, name)(args[0].col), isinstance(args[0].kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        return Value(made.over(window), T.LongType() if whole and name == "sum" else sem.WIDE if isinstance(args[0].kind, T.DecimalType) else T.DoubleType())
    raise Unsupported(f"{name} over a window")


def _record(e: n.Record, rows: Rows) -> Value:
    return Value(F.concat(F.lit(e.table + ":"), lower(e.key, rows).col.cast("string")), T.StringType(), isinstance(e.key, n.Literal))


_LOWER = {
    n.Literal: lambda e, rows: literal(e.value, e.kind),
    n.Name: _name, n.Param: _param, n.Field: _field, n.Item: _item, n.Every: _every, n.Hop: _hop, n.Record: _record,
    n.Call: _call, n.Over: over, n.Unary: _unary, n.Binary: _binary, n.Branch: _branch, n.Block: _block, n.Query: _query,
    n.Cast: lambda e, rows: cast(e.kind, lower(e.value, rows)),
    n.ArrayOf: lambda e, rows: array([lower(x, rows) for x in e.items]),
    n.ObjectOf: lambda e, rows: struct([(k, lower(v, rows)) for k, v in e.items]),
    n.Span: lambda e, rows: nothing(),
}


def path_of(e: n.Expr) -> str | None:
    """Dotted text of a path."""
    if isinstance(e, n.Name):
        return e.name
    if isinstance(e, n.Field):
        base = path_of(e.base)
        return f"{base}.{e.name}" if base else None
    if isinstance(e, n.Every):
        return path_of(e.base)
    return None


def output_name(e: n.Expr) -> str:
    if isinstance(e, n.Call):
        return e.name
    if isinstance(e, n.Over):
        return e.call.name
    if isinstance(e, (n.Item, n.Hop)):
        return render(e)
    return path_of(e) or "value"


def walk(e: object):
    """All nodes below, e included."""
    if isinstance(e, n.Node):
        yield e
        for v in e.__dict__.values():
            yield from walk(v)
    elif isinstance(e, tuple):
        for x in e:
            yield from walk(x)


def conjuncts(e: n.Expr | None) -> list[n.Expr]:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, n.Binary) and e.op == "and" else [e]
