"""rand::*, crypto::*, encoding::*, value::*"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import Value
from .objects import _common
from .registry import BOOL, DOUBLE, LONG, STRING, function, integer, num, s

# The alphabet of rand::string.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


@function("rand")
def rand():
    return Value(F.rand(), DOUBLE)


@function("rand::bool")
def rand_bool():
    return Value(F.rand() < 0.5, BOOL)


@function("rand::float")
def rand_float(low=None, high=None):
    if low is None:
        return rand()
    return Value(num(low) + F.rand() * (num(high) - num(low)), DOUBLE)


@function("rand::int")
def rand_int(low=None, high=None):
    if low is None:
        return Value((F.rand() * 2147483647).cast("long"), LONG)
    a, b = num(low).cast("long"), num(high).cast("long")
    return Value(a + F.floor(F.rand() * (b - a + 1)), LONG)


@function("rand::string")
def rand_string(n=None):
    size = F.lit(16) if n is None else integer(n)
    # one draw a letter: rand() inside a lambda is drawn once a row, so letters come from digests of a fresh uuid
    seed = F.uuid()
    letter = lambda i: F.substring(F.lit(LETTERS), (F.pmod(F.xxhash64(seed, i), F.lit(len(LETTERS))) + 1).cast("int"), F.lit(1))
    return Value(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), letter), ""), STRING)


@function("rand::uuid")
def rand_uuid():
    return Value(F.uuid(), STRING)


@function("rand::enum")
def rand_enum(*v):
    if len(v) == 1 and v[0].array:
        return Value(F.get(F.shuffle(v[0].col), F.lit(0)), v[0].kind.elementType)
    kind = _common([x.kind for x in v])
    return Value(F.get(F.shuffle(F.array(*(x.col.cast(kind) for x in v))), F.lit(0)), kind)


for _name, _f in (("md5", F.md5), ("sha1", F.sha1), ("sha256", lambda c: F.sha2(c, 256)), ("sha512", lambda c: F.sha2(c, 512))):
    function(f"crypto::{_name}")(lambda v, f=_f: Value(f(F.encode(s(v), "UTF-8")), STRING))


@function("encoding::base64::encode")
def base64_encode(v):
    raw = v.col if isinstance(v.kind, T.BinaryType) else F.encode(s(v), "UTF-8")
    return Value(F.regexp_replace(F.base64(raw), "\\s", ""), STRING)


@function("encoding::base64::decode")
def base64_decode(v):
    return Value(F.decode(F.unbase64(s(v)), "UTF-8"), STRING)


@function("value::coalesce", "value::default")
def coalesce(*v):
    some = [x for x in v if not x.null]
    if not some:
        return Value(F.lit(None), T.NullType())
    kind = _common([x.kind for x in some])
    return Value(F.coalesce(*(x.col.cast(kind) for x in some)), kind)
