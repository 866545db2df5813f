"""time::*; all in UTC, the session's time zone."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import Value
from .registry import CONSTANTS, LONG, TIME, function, num, s


@function("time::now", "now")
def now():
    return Value(F.current_timestamp(), TIME)


CONSTANTS |= {"current_timestamp": now, "time::now": now}


def moment(v: Value | None):
    if v is None:
        return F.current_timestamp()
    if isinstance(v.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return v.col.cast("timestamp")
    return F.timestamp_millis(v.col.cast("long")) if v.number else s(v).try_cast("timestamp")


def _part(name: str, f):
    function(f"time::{name}")(lambda v=None: Value(f(moment(v)).cast("long"), LONG))


_part("unix", F.unix_seconds)
_part("millis", F.unix_millis)
_part("year", F.year)
_part("month", F.month)
_part("day", F.dayofmonth)
_part("hour", F.hour)
_part("minute", F.minute)
_part("second", F.second)
_part("yday", F.dayofyear)
_part("wday", lambda t: F.weekday(t) + 1)


@function("time::from::unix")
def from_unix(v):
    return Value(F.timestamp_seconds(num(v).cast("long")), TIME)


@function("time::from::millis")
def from_millis(v):
    return Value(F.timestamp_millis(num(v).cast("long")), TIME)
