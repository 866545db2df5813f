"""Key-value entries with expiry. A session's own entries are few and stay on the driver; ``scan_table`` is for tables of them."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyValues:
    def __init__(self, spark: SparkSession, clock=time.time):
        self.spark, self.clock = spark, clock
        self.items: dict[str, tuple[object, float | None]] = {}

    def get(self, key: str):
        value, until = self.items.get(key, (None, None))
        if until is not None and until <= self.clock():
            self.items.pop(key, None)
            return None
        return value

    def set(self, key: str, value, ttl: float | None = None):
        self.items[key] = (value, self.clock() + ttl if ttl else None)
        return value

    def delete(self, key: str) -> bool:
        return self.items.pop(key, None) is not None

    def scan(self, prefix: str = "") -> list[dict]:
        now, out = self.clock(), []
        for key in sorted(k for k in self.items if k.startswith(prefix)):
            value, until = self.items[key]
            if until is None or until > now:
                out.append({"key": key, "value": value} | ({"ttl": int(until - now)} if until is not None else {}))
        return out

    def call(self, name: str, args: list):
        f = {"kv::get": self.get, "kv::set": self.set, "kv::del": self.delete, "kv::scan": self.scan}[name]
        return f(*(str(a) if i == 0 else a for i, a in enumerate(args)))


def scan_table(df: DataFrame, prefix: str, now: Column | None = None) -> DataFrame:
    """Entries (key, value, expires_at) under a prefix that have not expired, with ttl in seconds. The prefix reaches the scan."""
    now = F.current_timestamp() if now is None else now
    live = df.where(F.col("key").startswith(prefix)).where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return live.select("key", "value", (F.unix_seconds("expires_at") - F.unix_seconds(now)).alias("ttl"))
