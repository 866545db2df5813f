"""array::*"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import Value, eq, truthy
from .registry import BOOL, LONG, STRING, arr, function, integer, same
from .strings import _literal


def _has(box: Value, item: Column, kind: T.DataType) -> Column:
    return F.exists(box.col, lambda y: eq(Value(y, box.kind.elementType), Value(item, kind)).col)


def _one(a: Value, v: Value) -> tuple[Value, Column]:
    """An array and an item, in one element type."""
    if v.null:
        return arr(a), F.lit(None).cast(arr(a).kind.elementType)
    a, b = same(a, Value(F.array(v.col), T.ArrayType(v.kind)))
    return a, v.col.cast(b.kind.elementType)


@function("array::add")
def add(a, v):
    a, item = _one(a, v)
    return Value(F.when(_has(a, item, a.kind.elementType), a.col).otherwise(F.array_append(a.col, item)), a.kind)


@function("array::append", "array::push")
def append(a, v):
    a, item = _one(a, v)
    return Value(F.array_append(a.col, item), a.kind)


@function("array::prepend")
def prepend(a, v):
    a, item = _one(a, v)
    return Value(F.array_prepend(a.col, item), a.kind)


@function("array::all")
def every(a):
    a = arr(a)
    return Value(F.forall(a.col, lambda x: truthy(Value(x, a.kind.elementType))), BOOL)


@function("array::any")
def some(a):
    a = arr(a)
    return Value(F.exists(a.col, lambda x: truthy(Value(x, a.kind.elementType))), BOOL)


@function("array::at")
def at(a, i):
    a, k = arr(a), integer(i)
    return Value(F.get(a.col, F.when(k < 0, F.size(a.col) + k).otherwise(k)), a.kind.elementType)


@function("array::concat")
def concat(*v):
    out = arr(v[0])
    for b in v[1:]:
        x, y = same(out, b)
        out = Value(F.concat(x.col, y.col), x.kind)
    return out


@function("array::complement")
def complement(a, b):
    a, b = same(a, b)
    return Value(F.filter(a.col, lambda x: ~_has(b, x, a.kind.elementType)), a.kind)


@function("array::difference")
def difference(a, b):
    a, b = same(a, b)
    return Value(F.concat(complement(a, b).col, complement(b, a).col), a.kind)


@function("array::distinct")
def distinct(a):
    a = arr(a)
    return Value(F.array_distinct(a.col), a.kind)


@function("array::find_index")
def find_index(a, v):
    a, item = _one(a, v)
    return Value((F.coalesce(F.array_position(a.col, item), F.lit(0)) - 1).cast("long"), LONG)


@function("array::first")
def first(a):
    a = arr(a)
    return Value(F.get(a.col, F.lit(0)), a.kind.elementType)


@function("array::last")
def last(a):
    a = arr(a)
    return Value(F.get(a.col, F.size(a.col) - 1), a.kind.elementType)


@function("array::flatten")
def flatten(a):
    a = arr(a)
    if not isinstance(a.kind.elementType, T.ArrayType):
        return a
    inner = a.kind.elementType
    return Value(F.flatten(F.transform(a.col, lambda x: F.coalesce(x, F.array().cast(inner)))), inner)


@function("array::insert")
def insert(a, v, i):
    a, item = _one(a, v)
    k, n = integer(i), F.size(a.col)
    place = F.least(F.greatest(F.when(k < 0, n + k).otherwise(k), F.lit(0)), n)
    # in parts, as array_insert pads beyond the end
    return Value(F.concat(F.slice(a.col, F.lit(1), place), F.array(item), F.slice(a.col, place + 1, n)), a.kind)


@function("array::intersect")
def intersect(a, b):
    a, b = same(a, b)
    return Value(F.array_intersect(a.col, b.col), a.kind)


@function("array::join")
def join(sep, a):
    return Value(F.array_join(arr(a).col.cast("array<string>"), _literal(sep)), STRING)


@function("array::len", "array::length")
def length(a):
    return Value(F.size(arr(a).col).cast("long"), LONG)


@function("array::pop")
def pop(a):
    a = arr(a)
    return Value(F.slice(a.col, F.lit(1), F.greatest(F.size(a.col) - 1, F.lit(0))), a.kind)


@function("array::remove")
def remove(a, i):
    a, k = arr(a), integer(i)
    place = F.when(k < 0, F.size(a.col) + k).otherwise(k)
    return Value(F.filter(a.col, lambda _, j: j != place), a.kind)


@function("array::reverse")
def reverse(a):
    a = arr(a)
    return Value(F.reverse(a.col), a.kind)


@function("array::shuffle")
def shuffle(a):
    a = arr(a)
    return Value(F.shuffle(a.col), a.kind)


@function("array::slice")
def slice_(a, start, length=None):
    a, k = arr(a), integer(start)
    n = F.size(a.col)
    first = F.least(F.greatest(F.when(k < 0, n + k).otherwise(k), F.lit(0)), n)
    size = n if length is None else F.when(integer(length) < 0, F.greatest(n + integer(length) - first, F.lit(0))).otherwise(integer(length))
    return Value(F.slice(a.col, first + 1, size), a.kind)


@function("array::sort", "array::sort::asc")
def sort(a):
    a = arr(a)
    return Value(F.sort_array(a.col), a.kind)


@function("array::sort::desc")
def sort_desc(a):
    a = arr(a)
    return Value(F.sort_array(a.col, False), a.kind)


@function("array::union")
def union(a, b):
    a, b = same(a, b)
    return Value(F.array_union(a.col, b.col), a.kind)


