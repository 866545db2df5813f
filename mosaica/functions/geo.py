"""geometry::* and geo::*: GeoJSON-like structs (type, coordinates), and Column arithmetic over them."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import Value
from .registry import BOOL, DOUBLE, STRING, function, integer, num

# Mean earth radius in metres; the letters of a geohash.
RADIUS = 6_371_008.8
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"

_LINE = T.ArrayType(T.ArrayType(DOUBLE))


def _geometry(kind: str, coordinates: Column, nested: T.DataType) -> Value:
    shape = T.StructType([T.StructField("type", STRING), T.StructField("coordinates", nested)])
    return Value(F.struct(F.lit(kind).alias("type"), coordinates.cast(nested).alias("coordinates")), shape)


@function("geometry::point")
def point(lon, lat=None):
    return _geometry("Point", lon.col if lat is None else F.array(num(lon), num(lat)), T.ArrayType(DOUBLE))


@function("geometry::line")
def line(v):
    return _geometry("LineString", v.col, _LINE)


@function("geometry::polygon")
def polygon(v):
    if not isinstance(v.kind.elementType, T.ArrayType) or not isinstance(v.kind.elementType.elementType, T.ArrayType):
        return _geometry("Polygon", F.array(v.col), T.ArrayType(_LINE))
    return _geometry("Polygon", v.col, T.ArrayType(_LINE))


def _depth(v: Value) -> int:
    """How deep coordinates nest: 1 point, 2 line, 3 polygon; 0: no geometry."""
    if not isinstance(v.kind, T.StructType) or "coordinates" not in v.kind.fieldNames():
        return 0
    kind, n = v.kind["coordinates"].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def lon_lat(v: Value) -> tuple[Column, Column] | None:
    """Longitude and latitude of a point; NULL for other shapes; None if the type cannot be a point."""
    if v.array:
        return F.get(v.col, F.lit(0)).cast("double"), F.get(v.col, F.lit(1)).cast("double")
    if _depth(v) != 1:
        return None
    c = F.when(v.col.getField("type") == "Point", v.col.getField("coordinates")) if "type" in v.kind.fieldNames() else v.col.getField("coordinates")
    return F.get(c, F.lit(0)).cast("double"), F.get(c, F.lit(1)).cast("double")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


@function("geo::distance")
def distance(a, b):
    x, y = lon_lat(a), lon_lat(b)
    return Value(haversine(*x, *y) if x and y else F.lit(None).cast("double"), DOUBLE)


def _ring(v: Value) -> Column | None:
    return F.get(v.col.getField("coordinates"), F.lit(0)) if _depth(v) == 3 else None


@function("geo::area")
def area(v):
    """Of the outer ring, in square degrees."""
    ring = _ring(v)
    if ring is None:
        return Value(F.lit(0.0), DOUBLE)
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.get(ring, i), F.lit(0)) * F.get(F.get(ring, F.pmod(i + 1, n)), F.lit(1)) - F.get(F.get(ring, F.pmod(i + 1, n)), F.lit(0)) * F.get(F.get(ring, i), F.lit(1)))
    return Value(F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)) / 2).otherwise(0.0), DOUBLE)


@function("geo::contains")
def contains(shape, p):
    """Even-odd rule over the outer ring."""
    ring, at = _ring(shape), lon_lat(p)
    if ring is None or at is None:
        return Value(F.lit(False), BOOL)
    x, y = at
    n = F.size(ring)
    corner = lambda i, k: F.get(F.get(ring, i), F.lit(k))

    def crosses(i):
        j = F.pmod(i + n - 1, n)
        beyond = (corner(i, 1) > y) != (corner(j, 1) > y)
        return beyond & (x < (corner(j, 0) - corner(i, 0)) * (y - corner(i, 1)) / F.nullif(corner(j, 1) - corner(i, 1), F.lit(0.0)) + corner(i, 0))

    inside = F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1
    return Value(F.coalesce((n >= 3) & inside, F.lit(False)), BOOL)


def geohash(lon: Column, lat: Column, precision: int) -> Column:
    """Interleaved halvings of longitude and latitude, five bits a letter."""
    bits = 5 * precision
    even, odd = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, k: F.least(F.floor((v - low) / span * (1 << k)), F.lit((1 << k) - 1)).cast("long")
    x, y = cell(lon, -180.0, 360.0, even), cell(lat, -90.0, 180.0, odd)
    bit = lambda i: F.shiftright(x, even - 1 - i // 2).bitwiseAND(F.lit(1)) if i % 2 == 0 else F.shiftright(y, odd - 1 - i // 2).bitwiseAND(F.lit(1))
    letter = lambda k: functools.reduce(lambda a, i: a * 2 + bit(i), range(5 * k, 5 * k + 5), F.lit(0))
    return F.concat(*(F.substring(F.lit(GEOHASH), (letter(k) + 1).cast("int"), F.lit(1)) for k in range(precision)))


@function("geo::hash::encode", "geo::hash")
def hash_encode(p, precision=None):
    from ..plans.constants import value_of

    at = lon_lat(p)
    k = 12 if precision is None else max(1, min(12, int(value_of(integer(precision)))))
    return Value(geohash(*at, k) if at else F.lit(None).cast("string"), STRING)


@function("geo::hash::decode")
def hash_decode(h):
    """Centre of the cell, as a point."""
    letters = F.split(F.lower(h.col), "")
    bits = F.array_join(F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.lpad(F.bin(F.instr(F.lit(GEOHASH), c) - 1), 5, "0")), "")
    n = F.char_length(bits)
    pick = lambda odd: F.array_join(F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i % 2 == odd), lambda i: F.substring(bits, i, F.lit(1))), "")
    place = lambda b, low, span: low + (F.conv(b, 2, 10).cast("double") + 0.5) / F.pow(F.lit(2.0), F.char_length(b)) * span
    return _geometry("Point", F.array(place(pick(1), -180.0, 360.0), place(pick(0), -90.0, 180.0)), T.ArrayType(DOUBLE))
