"""type::*, record::* and meta::*"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import WIDE, Value, truthy
from .registry import BOOL, DOUBLE, LONG, STRING, TIME, arr, function, num, s


def cast(kind: str, v: Value) -> Value:
    if kind == "bool":
        if v.string:
            return Value(F.lower(s(v)) == "true", BOOL)
        return Value(truthy(v), BOOL)
    if kind == "int":
        return Value(F.coalesce(v.col.cast("long") if v.number else num(v).cast("long"), F.lit(0).cast("long")), LONG)
    if kind in ("float", "number"):
        if kind == "number" and v.number:
            return v
        return Value(num(v), DOUBLE)
    if kind == "decimal":
        return Value(F.coalesce(s(v).try_cast(WIDE), F.lit(0).cast(WIDE)), WIDE)
    if kind == "string":
        return Value(s(v), STRING)
    if kind == "datetime":
        return Value(v.col if isinstance(v.kind, T.TimestampType) else F.timestamp_millis(v.col.cast("long")) if v.number else s(v).try_cast("timestamp"), TIME)
    raise ValueError(f"no cast to {kind}")


for _kind in ("bool", "int", "decimal", "string", "datetime"):
    function(f"type::{_kind}")(lambda v, k=_kind: cast(k, v))


@function("type::float", "type::number")
def number(v):
    return cast("float", v)


@function("type::table")
def table(v):
    return Value(s(v), STRING)


@function("type::record")
def record(a, key=None):
    return Value(F.concat(s(a), F.lit(":"), s(key)) if key is not None else s(a), STRING)


@function("type::array")
def array(v):
    return arr(v)


def _test(name: str, kinds: tuple):
    def test(v):
        return Value(v.col.isNotNull() if isinstance(v.kind, kinds) else F.lit(False), BOOL)

    function(f"type::is::{name}")(test)


_test("array", (T.ArrayType,))
_test("bool", (T.BooleanType,))
_test("datetime", (T.TimestampType, T.DateType, T.TimestampNTZType))
_test("number", (T.NumericType,))
_test("object", (T.StructType, T.MapType))


@function("type::is::null", "type::is::none")
def is_null(v):
    return Value(v.col.isNull(), BOOL)


@function("type::is::string")
def is_string(v):
    return Value(v.col.isNotNull() if v.string else F.lit(False), BOOL)


_RECORD = r"^[A-Za-z_]\w*:.+"


@function("type::is::record", "record::exists")
def is_record(v):
    """Record ids are texts ``table:key``."""
    return Value(F.coalesce(F.rlike(v.col, F.lit(_RECORD)), F.lit(False)) if v.string else F.lit(False), BOOL)


@function("record::id", "meta::id")
def record_id(v):
    return Value(F.when(F.contains(s(v), F.lit(":")), F.substring(s(v), F.instr(s(v), ":") + 1, F.lit(1 << 30))).otherwise(s(v)), STRING)


@function("record::table", "record::tb", "meta::tb")
def record_table(v):
    return Value(F.when(F.contains(s(v), F.lit(":")), F.substring_index(s(v), ":", 1)).otherwise(s(v)), STRING)
