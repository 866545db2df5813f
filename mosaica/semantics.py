"""Comparison, truth and arithmetic of the language, as Column expressions over statically typed values.

The language differs from SQL: logic has two values, NULL equals NULL, and a missing value sorts below every other. Where one
side is a literal the forms below stay simple enough for Parquet push-down.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WIDE = T.DecimalType(38, 10)
MOMENTS = (T.TimestampType, T.TimestampNTZType)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, NUMBERS)


@dataclass(frozen=True, eq=False)
class Value:
    """A Column, its type, and whether it is a literal other than NULL."""

    col: Column
    kind: T.DataType
    literal: bool = False

    @property
    def number(self) -> bool:
        return isinstance(self.kind, NUMBERS)

    @property
    def string(self) -> bool:
        return isinstance(self.kind, T.StringType)

    @property
    def array(self) -> bool:
        return isinstance(self.kind, T.ArrayType)

    @property
    def null(self) -> bool:
        return isinstance(self.kind, T.NullType)

    @property
    def object(self) -> bool:
        return isinstance(self.kind, (T.StructType, T.MapType))


def nothing() -> Value:
    return Value(F.lit(None), T.NullType())


def boolean(c: Column) -> Value:
    return Value(c, T.BooleanType())


def rank(kind: T.DataType) -> int:
    """Place of a type in the order across types."""
    order = ((T.NullType,), (T.BooleanType,), NUMBERS, (T.StringType,), (T.DayTimeIntervalType, T.YearMonthIntervalType), (T.TimestampType, T.TimestampNTZType, T.DateType), (T.ArrayType,), (T.StructType, T.MapType), (T.BinaryType,))
    return next((i for i, kinds in enumerate(order) if isinstance(kind, kinds)), len(order))


def truthy(v: Value) -> Column:
    """False for missing, "", 0, [] and {}; true for anything else. Never NULL."""
    if v.null:
        return F.lit(False)
    if isinstance(v.kind, T.BooleanType):
        return v.col if v.literal else F.coalesce(v.col, F.lit(False))
    if v.number:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.string:
        return F.coalesce(v.col != "", F.lit(False))
    if v.array or isinstance(v.kind, T.MapType):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def condition(v: Value) -> Column:
    """truthy() for a filter, where NULL drops a row as well as false: a boolean stays as it is, so that it can be pushed down."""
    return v.col if isinstance(v.kind, T.BooleanType) else truthy(v)


def as_number(v: Value) -> Value:
    return v if v.number else Value(v.col.try_cast("double") if v.string else v.col.cast("double"), T.DoubleType())


def _comparable(a: Value, b: Value, strict: bool = False) -> tuple[Column, Column] | None:
    if a.number and b.number or type(a.kind) is type(b.kind):
        return a.col, b.col
    if strict:
        return None
    if a.number and b.string:
        return a.col, b.col.try_cast("double")
    if a.string and b.number:
        return a.col.try_cast("double"), b.col
    if rank(a.kind) == rank(b.kind):
        return a.col, b.col
    return None


def eq(a: Value, b: Value, strict: bool = False) -> Value:
    if a.null or b.null:
        return boolean(a.col.isNull() & b.col.isNull()) if not (a.null and b.null) else boolean(F.lit(True))
    pair = _comparable(a, b, strict)
    if pair is None:
        return boolean(a.col.isNull() & b.col.isNull())
    return boolean(pair[0].eqNullSafe(pair[1]))


def ne(a: Value, b: Value) -> Value:
    return boolean(~eq(a, b).col)


def _below(a: Value, b: Value, test: Callable[[Column, Column], Column]) -> Column:
    """test on two present values; across types the order of types decides."""
    pair = _comparable(a, b)
    return test(*pair) if pair is not None else test(F.lit(rank(a.kind)), F.lit(rank(b.kind)))


def lt(a: Value, b: Value) -> Value:
    if a.null or b.null:
        return boolean(F.lit(False) if b.null else b.col.isNotNull())
    test = _below(a, b, lambda x, y: x < y)
    if b.literal:
        return boolean(a.col.isNull() | test)
    if a.literal:
        return boolean(b.col.isNotNull() & test)
    return boolean((a.col.isNull() & b.col.isNotNull()) | F.coalesce(a.col.isNotNull() & b.col.isNotNull() & test, F.lit(False)))


def le(a: Value, b: Value) -> Value:
    if a.null:
        return boolean(F.lit(True))
    if b.null:
        return boolean(a.col.isNull())
    test = _below(a, b, lambda x, y: x <= y)
    if b.literal:
        return boolean(a.col.isNull() | test)
    if a.literal:
        return boolean(b.col.isNotNull() & test)
    return boolean(a.col.isNull() | F.coalesce(b.col.isNotNull() & test, F.lit(False)))


def gt(a: Value, b: Value) -> Value:
    return lt(b, a)


def ge(a: Value, b: Value) -> Value:
    return le(b, a)


# ---------------------------------------------------------------- arithmetic
def _plain(v: Value, other: Value) -> Value:
    """A missing operand gives way to the other one."""
    return Value(F.coalesce(v.col, other.col) if not v.null else other.col, other.kind if v.null else v.kind)


def add(a: Value, b: Value) -> Value:
    ka, kb = a.kind, b.kind
    if isinstance(ka, MOMENTS) and isinstance(kb, T.DayTimeIntervalType) or isinstance(ka, T.DayTimeIntervalType) and isinstance(kb, (T.DayTimeIntervalType, *MOMENTS)):
        return Value(a.col + b.col, ka if isinstance(ka, MOMENTS) else kb)
    if a.string or b.string:
        return Value(F.concat(text(a), text(b)), T.StringType())
    if a.array and b.array:
        return Value(F.concat(a.col, b.col), ka)
    return arithmetic("+", a, b)


def text(v: Value) -> Column:
    return F.coalesce(v.col.cast("string"), F.lit("")) if not v.null else F.lit("")


def subtract(a: Value, b: Value) -> Value:
    if isinstance(a.kind, MOMENTS) and isinstance(b.kind, (T.DayTimeIntervalType, *MOMENTS)):
        return Value(a.col - b.col, a.kind if isinstance(b.kind, T.DayTimeIntervalType) else T.DayTimeIntervalType())
    return arithmetic("-", a, b)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Doubles stay doubles; integers stay exact, division of these and anything with decimals is decimal of scale 10."""
    a, b = (as_number(v) if not (v.number or v.null) else v for v in (a, b))
    if a.null and b.null:
        return nothing()
    a, b = _plain(a, b), _plain(b, a)
    x, y = a.col, b.col
    if any(isinstance(v.kind, (T.DoubleType, T.FloatType)) for v in (a, b)):
        x, y, kind = x.cast("double"), y.cast("double"), T.DoubleType()
    elif op != "/" and all(isinstance(v.kind, _INTEGERS) for v in (a, b)):
        x, y, kind = x.cast("long"), y.cast("long"), T.LongType()
    else:
        whole = all(isinstance(v.kind, _INTEGERS) for v in (a, b))
        x, y, kind = (x.cast("decimal(19,0)"), y.cast("decimal(19,0)"), WIDE) if whole else (x.cast("decimal(28,10)"), y.cast("decimal(28,10)"), WIDE)
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.try_mod(x, y)}[op]()
    return Value(out.cast(kind) if kind == WIDE else out, kind)


def power(a: Value, b: Value) -> Value:
    return Value(F.pow(as_number(a).col, as_number(b).col), T.DoubleType())


# ---------------------------------------------------------------- membership
def holds(box: Value, item: Value) -> Value:
    """Array membership, substring, or key of an object."""
    if box.array:
        inner = box.kind.elementType
        if item.null:
            return boolean(F.coalesce(F.exists(box.col, lambda x: x.isNull()), F.lit(False)))
        return boolean(F.coalesce(F.exists(box.col, lambda x: eq(Value(x, inner), item).col), F.lit(False)))
    if box.string:
        return boolean(F.coalesce(F.contains(box.col, text(item)), F.lit(False)))
    if isinstance(box.kind, T.MapType):
        return boolean(F.coalesce(F.map_contains_key(box.col, item.col), F.lit(False)))
    if isinstance(box.kind, T.StructType):
        return boolean(box.col.isNotNull() & item.col.isin(box.kind.fieldNames()))
    return boolean(F.lit(False))


def all_equal(box: Value, item: Value) -> Value:
    if not box.array:
        return eq(box, item)
    return boolean(F.coalesce((F.size(box.col) > 0) & F.forall(box.col, lambda x: eq(Value(x, box.kind.elementType), item).col), F.lit(False)))


def any_equal(box: Value, item: Value) -> Value:
    return holds(box, item) if box.array else eq(box, item)


def holds_each(box: Value, items: Value, how: str) -> Value:
    """how: all, any or none of items are in box."""
    if not items.array:
        items = Value(F.array(items.col), T.ArrayType(items.kind))
    own = lambda x: holds(box, Value(x, items.kind.elementType)).col
    if how == "all":
        return boolean(F.coalesce(F.forall(items.col, own), F.lit(False)))
    found = F.coalesce(F.exists(items.col, own), F.lit(False))
    return boolean(found if how == "any" else ~found)


def matches(v: Value, query: Value) -> Value:
    """Every word of the query is found in the text, both lowered."""
    words = F.filter(F.split(F.lower(query.col), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    low = F.lower(text(v)) if not v.array else F.lower(F.array_join(v.col.cast("array<string>"), " "))
    return boolean(F.coalesce((F.size(words) > 0) & F.forall(words, lambda w: F.contains(low, w)), F.lit(False)))


def sort_key(v: Value, descending: bool) -> list[Column]:
    """Missing first, last if descending."""
    return [v.col.desc_nulls_last() if descending else v.col.asc_nulls_first()]
