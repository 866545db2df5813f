"""The table of functions, and how arguments are coerced: NULL is "", 0 or [], and a scalar is a list of one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import Value, as_number, is_number

FUNCTIONS: dict[str, Callable[..., Value]] = {}
CONSTANTS: dict[str, Callable[[], Value]] = {}

STRING, LONG, DOUBLE, BOOL, TIME = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


class UnknownFunction(ValueError):
    pass


def function(*names: str):
    def register(f):
        for name in names:
            FUNCTIONS[name] = f
        return f

    return register


def call(name: str, args: list[Value]) -> Value:
    f = FUNCTIONS.get(name.lower())
    if f is None:
        raise UnknownFunction(f"unknown function {name}")
    try:
        return f(*args)
    except TypeError as e:
        raise ValueError(f"{name}: {e}") from e


def constant(name: str) -> Value | None:
    made = CONSTANTS.get(name.lower())
    return made() if made else None


def s(v: Value) -> Column:
    if v.null:
        return F.lit("")
    if v.array:
        return F.coalesce(F.to_json(v.col), F.lit(""))
    return F.coalesce(v.col.cast("string"), F.lit(""))


def num(v: Value) -> Column:
    """As double; 0 where it is none."""
    return F.coalesce(as_number(v).col.cast("double"), F.lit(0.0)) if v.number or v.string else F.lit(0.0)


def exact(v: Value) -> Value:
    """A number in its own type; 0 where it is none."""
    if v.number:
        return Value(F.coalesce(v.col, F.lit(0).cast(v.kind)), v.kind)
    return Value(num(v), DOUBLE)


def integer(v: Value) -> Column:
    return num(v).cast("int") if not isinstance(v.kind, (T.IntegerType, T.LongType)) else F.coalesce(v.col.cast("int"), F.lit(0))


def arr(v: Value) -> Value:
    if v.array:
        return Value(F.coalesce(v.col, F.array().cast(v.kind)), v.kind)
    if v.null:
        return Value(F.array().cast("array<string>"), T.ArrayType(STRING))
    return Value(F.when(v.col.isNull(), F.array().cast(T.ArrayType(v.kind))).otherwise(F.array(v.col)), T.ArrayType(v.kind))


def same(a: Value, b: Value) -> tuple[Value, Value]:
    """Two arrays brought to one element type."""
    a, b = arr(a), arr(b)
    x, y = a.kind.elementType, b.kind.elementType
    if type(x) is type(y) and x == y:
        return a, b
    numbers = is_number(x) and is_number(y)
    kind = T.ArrayType(DOUBLE if numbers else STRING)
    return Value(a.col.cast(kind), kind), Value(b.col.cast(kind), kind)


def like(box: Value, item: Value) -> Column:
    """item in the element type of box."""
    return item.col.cast(box.kind.elementType)
