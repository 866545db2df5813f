"""object::*; objects are structs, or maps where keys are not known beforehand."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import Value, is_number
from .registry import LONG, STRING, arr, function


def _common(kinds: list[T.DataType]) -> T.DataType:
    if kinds and all(k == kinds[0] for k in kinds):
        return kinds[0]
    if kinds and all(isinstance(k, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for k in kinds):
        return LONG
    return T.DoubleType() if kinds and all(is_number(k) for k in kinds) else STRING


def _fields(v: Value) -> list[tuple[str, Value]]:
    return [(f.name, Value(v.col.getField(f.name), f.dataType)) for f in v.kind.fields]


@function("object::keys")
def keys(v):
    if isinstance(v.kind, T.StructType):
        return Value(F.when(v.col.isNotNull(), F.array(*map(F.lit, v.kind.fieldNames()))).otherwise(F.array().cast("array<string>")), T.ArrayType(STRING))
    return Value(F.coalesce(F.map_keys(v.col), F.array().cast("array<string>")) if v.object else F.array().cast("array<string>"), T.ArrayType(STRING))


@function("object::values")
def values(v):
    if isinstance(v.kind, T.StructType):
        kind = _common([f.dataType for f in v.kind.fields])
        return Value(F.array(*(x.col.cast(kind) for _, x in _fields(v))).cast(T.ArrayType(kind)), T.ArrayType(kind))
    return Value(F.map_values(v.col), T.ArrayType(v.kind.valueType)) if v.object else Value(F.array().cast("array<string>"), T.ArrayType(STRING))


@function("object::len", "object::length")
def length(v):
    if isinstance(v.kind, T.StructType):
        return Value(F.when(v.col.isNotNull(), F.lit(len(v.kind.fields))).otherwise(0).cast("long"), LONG)
    return Value(F.coalesce(F.size(v.col), F.lit(0)).cast("long") if v.object else F.lit(0).cast("long"), LONG)


@function("object::entries")
def entries(v):
    """Pairs [key, value]; values become text where that is not their type."""
    pair = T.ArrayType(T.ArrayType(STRING))
    if isinstance(v.kind, T.StructType):
        return Value(F.array(*(F.array(F.lit(k), x.col.cast("string")) for k, x in _fields(v))).cast(pair), pair)
    if isinstance(v.kind, T.MapType):
        return Value(F.transform(F.map_entries(v.col), lambda e: F.array(e["key"].cast("string"), e["value"].cast("string"))), pair)
    return Value(F.array().cast(pair), pair)


@function("object::from_entries")
def from_entries(v):
    a = arr(v)
    inner = a.kind.elementType
    value = inner.elementType if isinstance(inner, T.ArrayType) else STRING
    kind = T.MapType(STRING, value)
    if not isinstance(inner, T.ArrayType):
        return Value(F.create_map().cast(kind), kind)
    return Value(F.map_from_entries(F.transform(a.col, lambda e: F.struct(F.get(e, F.lit(0)).cast("string").alias("key"), F.get(e, F.lit(1)).alias("value")))), kind)
