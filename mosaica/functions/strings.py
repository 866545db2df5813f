"""string::*"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import Value
from .registry import BOOL, LONG, STRING, arr, function, integer, s

WORDS = T.ArrayType(STRING)


@function("string::concat")
def concat(*v):
    return Value(F.concat(F.lit(""), *map(s, v)), STRING)


@function("string::contains")
def contains(a, b):
    return Value(F.contains(s(a), s(b)), BOOL)


@function("string::ends_with")
def ends_with(a, b):
    return Value(F.endswith(s(a), s(b)), BOOL)


@function("string::starts_with")
def starts_with(a, b):
    return Value(F.startswith(s(a), s(b)), BOOL)


@function("string::join")
def join(sep, *v):
    if len(v) == 1 and v[0].array:
        return Value(F.array_join(F.transform(v[0].col.cast("array<string>"), lambda x: F.coalesce(x, F.lit(""))), ",") if sep.null else F.array_join(arr(v[0]).col.cast("array<string>"), _literal(sep)), STRING)
    return Value(F.concat_ws(_literal(sep), *map(s, v)), STRING)


def _literal(v: Value):
    """A separator: functions that need a string instead of a Column get one by way of an expression."""
    return v.text if hasattr(v, "text") else _folded(v)


def _folded(v: Value) -> str:
    from ..plans.constants import text_of

    return text_of(v.col)


@function("string::len", "string::length")
def length(a):
    return Value(F.char_length(s(a)).cast("long"), LONG)


@function("string::lowercase")
def lowercase(a):
    return Value(F.lower(s(a)), STRING)


@function("string::uppercase")
def uppercase(a):
    return Value(F.upper(s(a)), STRING)


@function("string::repeat")
def repeat(a, n):
    return Value(F.repeat(s(a), F.greatest(integer(n), F.lit(0))), STRING)


@function("string::replace")
def replace(a, old, new):
    return Value(F.replace(s(a), s(old), s(new)), STRING)


@function("string::reverse")
def reverse(a):
    return Value(F.reverse(s(a)), STRING)


@function("string::slice")
def slice_(a, start, length=None):
    text, at = s(a), integer(start)
    n = F.char_length(text)
    first = F.greatest(F.when(at < 0, n + at).otherwise(at), F.lit(0))
    if length is None:
        return Value(F.substring(text, first + 1, n), STRING)
    k = integer(length)
    size = F.when(k < 0, F.greatest(n + k - first, F.lit(0))).otherwise(k)
    return Value(F.substring(text, first + 1, size), STRING)


@function("string::split")
def split(a, sep):
    return Value(F.split(s(a), F.concat(F.lit("\\Q"), s(sep), F.lit("\\E")), -1), WORDS)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


@function("string::trim")
def trim(a):
    return Value(trimmed(s(a)), STRING)


@function("string::words")
def words(a):
    return Value(F.filter(F.split(trimmed(s(a)), "\\s+"), lambda w: w != ""), WORDS)


@function("string::matches")
def matches(a, pattern):
    return Value(F.rlike(s(a), F.concat(F.lit("^(?:"), s(pattern), F.lit(")$"))), BOOL)


def _unmarked() -> tuple[str, str]:
    """Latin letters that decompose into an ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@function("string::slug")
def slug(a):
    low = F.lower(F.regexp_replace(F.translate(s(a), *_unmarked()), "\\p{M}+", ""))
    return Value(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", ""), STRING)


@function("string::capitalize")
def capitalize(a):
    return Value(F.concat(F.upper(F.left(s(a), F.lit(1))), F.substring(s(a), 2, 1 << 30)), STRING)


@function("string::pad_start")
def pad_start(a, n, fill=None):
    return _padded(a, n, fill, F.lpad)


@function("string::pad_end")
def pad_end(a, n, fill=None):
    return _padded(a, n, fill, F.rpad)


def _padded(a, n, fill, pad):
    size = integer(n)
    return Value(F.when(F.char_length(s(a)) >= size, s(a)).otherwise(pad(s(a), size, F.lit(" ") if fill is None else s(fill))), STRING)
