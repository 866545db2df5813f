"""math::* and the global aggregates as scalars over arrays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import WIDE, Value, is_number
from .registry import CONSTANTS, DOUBLE, LONG, arr, exact, function, integer, num

CONSTANTS |= {
    "math::pi": lambda: Value(F.pi(), DOUBLE),
    "math::e": lambda: Value(F.e(), DOUBLE),
    "math::tau": lambda: Value(F.pi() * 2, DOUBLE),
    "math::inf": lambda: Value(F.lit(1.7976931348623157e308), DOUBLE),
    "math::neg_inf": lambda: Value(F.lit(-1.7976931348623157e308), DOUBLE),
}


def _double(name: str, f):
    function(name)(lambda x: Value(f(num(x)), DOUBLE))


_double("math::sqrt", F.sqrt)
_double("math::exp", F.exp)
_double("math::ln", F.ln)
_double("math::log10", F.log10)
_double("math::log2", F.log2)


@function("math::abs")
def absolute(x):
    v = exact(x)
    return Value(F.abs(v.col), v.kind)


@function("math::sign")
def sign(x):
    return Value(F.signum(num(x)).cast("long"), LONG)


@function("math::ceil")
def ceil(x):
    return Value(F.ceil(num(x)), LONG)


@function("math::floor")
def floor(x):
    return Value(F.floor(num(x)), LONG)


@function("math::round")
def round_(x):
    """Halves go up."""
    return Value(F.floor(num(x) + 0.5), LONG)


@function("math::fixed")
def fixed(x, digits):
    """Halves go away from zero."""
    d = exact(x).col.cast("decimal(38,15)")
    unit = F.pow(F.lit(10.0), integer(digits))
    return Value((F.signum(d.cast("double")) * F.floor((F.abs(d) * unit.cast("decimal(20,5)")).cast(WIDE) + F.lit(0.5).cast("decimal(2,1)")) / unit).cast("double"), DOUBLE)


@function("math::pow")
def pow_(x, y):
    return Value(F.pow(num(x), num(y)), DOUBLE)


@function("math::log")
def log(x, base):
    return Value(F.ln(num(x)) / F.ln(num(base)), DOUBLE)


@function("math::clamp")
def clamp(x, low, high):
    return Value(F.greatest(num(low), F.least(num(high), num(x))), DOUBLE)


def _numbers(v: tuple[Value, ...]) -> Value:
    """The numbers among the arguments, or among the items of one array, as an array."""
    if len(v) == 1 and v[0].array:
        a = arr(v[0])
        kind = a.kind.elementType
        if not is_number(kind):
            return Value(F.filter(F.transform(a.col, lambda x: x.cast("string").try_cast("double")), lambda x: x.isNotNull()), T.ArrayType(DOUBLE))
        return Value(F.filter(a.col, lambda x: x.isNotNull()), a.kind)
    some = [x for x in v if x.number]
    if not some:
        return Value(F.array().cast("array<double>"), T.ArrayType(DOUBLE))
    whole = all(isinstance(x.kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for x in some)
    kind = LONG if whole else DOUBLE
    return Value(F.filter(F.array(*(x.col.cast(kind) for x in some)), lambda x: x.isNotNull()), T.ArrayType(kind))


def _item(a: Value) -> T.DataType:
    return a.kind.elementType


@function("math::min", "min", "array::min")
def least(*v):
    if len(v) == 1 and v[0].array and not is_number(v[0].kind.elementType):
        return Value(F.array_min(arr(v[0]).col), v[0].kind.elementType)
    a = _numbers(v)
    return Value(F.array_min(a.col), _item(a))


@function("math::max", "max", "array::max")
def greatest(*v):
    if len(v) == 1 and v[0].array and not is_number(v[0].kind.elementType):
        return Value(F.array_max(arr(v[0]).col), v[0].kind.elementType)
    a = _numbers(v)
    return Value(F.array_max(a.col), _item(a))


@function("math::sum", "sum")
def total(*v):
    a = _numbers(v)
    kind = LONG if isinstance(_item(a), (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) else DOUBLE
    return Value(F.aggregate(a.col, F.lit(0).cast(kind), lambda x, y: x + y.cast(kind)), kind)


@function("math::product")
def product(*v):
    a = _numbers(v)
    return Value(F.when(F.size(a.col) > 0, F.aggregate(a.col, F.lit(1.0), lambda x, y: x * y.cast("double"))), DOUBLE)


@function("math::mean", "avg")
def mean(*v):
    """Rounded to 10 places, halves away from zero."""
    a = _numbers(v)
    sums = F.aggregate(a.col, F.lit(0.0), lambda x, y: x + y.cast("double"))
    return Value(F.when(F.size(a.col) > 0, F.round(sums / F.size(a.col), 10)), DOUBLE)


@function("math::median")
def median(*v):
    a = F.array_sort(_numbers(v).col.cast("array<double>"))
    n = F.size(a)
    middle = (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2
    return Value(F.when(n > 0, F.round(middle, 10)), DOUBLE)


@function("count")
def count(a=None):
    if a is None:
        return Value(F.lit(1).cast("long"), LONG)
    return Value(F.size(arr(a).col).cast("long"), LONG)


