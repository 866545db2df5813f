"""vector::*: over arrays of numbers, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..semantics import Value, is_number
from .registry import DOUBLE, function


def _doubles(v: Value) -> Column | None:
    return v.col.cast("array<double>") if v.array and is_number(v.kind.elementType) else None


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _fold(a: Value, b: Value, term, done=lambda s: s) -> Value:
    x, y = _doubles(a), _doubles(b)
    if x is None or y is None:
        return Value(F.lit(0.0), DOUBLE)
    return Value(F.when(F.size(x) == F.size(y), done(_sum(F.zip_with(x, y, term)))), DOUBLE)


@function("vector::distance::euclidean")
def euclidean(a, b):
    return _fold(a, b, lambda x, y: (x - y) * (x - y), F.sqrt)


@function("vector::distance::manhattan")
def manhattan(a, b):
    return _fold(a, b, lambda x, y: F.abs(x - y))


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda p, q: p * q))


@function("vector::similarity::cosine")
def cosine(a, b):
    x, y = _doubles(a), _doubles(b)
    if x is None or y is None:
        return Value(F.lit(None).cast("double"), DOUBLE)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return Value(F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), F.when(norm == 0, F.lit(0.0)).otherwise(dot(x, y) / norm)), DOUBLE)


@function("vector::distance::cosine")
def cosine_distance(a, b):
    return Value(1 - cosine(a, b).col, DOUBLE)
