"""The verbs of a database client over a session, and a small PEP 249 face; all of them end in the same plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .lang.render import quoted
from .session import Session


def literal(v) -> str:
    """A Python value as text of the language."""
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k if k.isidentifier() else quoted(k)}: {literal(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else quoted(v) if isinstance(v, str) else str(v)


class Client:
    def __init__(self, session: Session):
        self.session = session

    def query(self, text: str, **params):
        return self.session.execute(text, **params)

    def select(self, what: str) -> DataFrame:
        return self.session.query(f"SELECT * FROM {what}")

    def create(self, what: str, data: dict):
        return self.session.execute(f"CREATE {what} CONTENT {literal(data)}")

    def insert(self, table: str, rows: list[dict]):
        return self.session.execute(f"INSERT INTO {table} {literal(rows)}")

    def update(self, what: str, data: dict):
        return self.session.execute(f"UPDATE {what} MERGE {literal(data)}")

    def upsert(self, what: str, data: dict):
        return self.session.execute(f"UPSERT {what} MERGE {literal(data)}")

    def delete(self, what: str):
        return self.session.execute(f"DELETE {what} RETURN BEFORE")

    def relate(self, source: str, kind: str, target: str, data: dict | None = None):
        return self.session.execute(f"RELATE {source}->{kind}->{target}" + (f" CONTENT {literal(data)}" if data else ""))

    def live(self, text: str, receive=None):
        return self.session.live(text, receive)

    def kill(self, subscription: str) -> bool:
        return self.session.feed.kill(subscription)

    def kv_get(self, key: str):
        return self.session.keys.get(key)

    def kv_set(self, key: str, value, ttl: float | None = None):
        return self.session.keys.set(key, value, ttl)

    def kv_del(self, key: str) -> bool:
        return self.session.keys.delete(key)

    def kv_scan(self, prefix: str = "") -> list[dict]:
        return self.session.keys.scan(prefix)

    def info(self) -> dict:
        return self.session.execute("INFO FOR DATABASE")

    def peek(self, table: str, limit: int = 100) -> list[dict]:
        """A first look at a table: 100 rows at most."""
        return [r.asDict(recursive=True) for r in self.select(table).limit(min(max(limit, 1), 100)).collect()]

    def graphql(self, text: str) -> DataFrame:
        """``{ table { field field } }``: the fields of a table; with none, all."""
        m = re.fullmatch(r"\s*(?:query\b[^{]*)?\{\s*(\w+)\s*(?:\{\s*([\w\s,]*)\})?\s*\}\s*", text)
        if not m:
            raise ValueError("expected { table { fields } }")
        return self.session.query(f"SELECT {', '.join((m[2] or '').replace(',', ' ').split()) or '*'} FROM {m[1]}")


class Cursor:
    """PEP 249 over Spark SQL: tables of the session are views; ``?`` marks parameters."""

    arraysize = 1

    def __init__(self, session: Session):
        self.session, self.description, self._rows = session, None, None

    def execute(self, sql: str, params: tuple = ()):
        df = self.session.sql(sql, params)
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
        self._rows = df.toLocalIterator(prefetchPartitions=True)
        return self

    def fetchone(self):
        r = next(self._rows, None)
        return None if r is None else tuple(r)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        out = []
        while len(out) < (size or self.arraysize) and (r := self.fetchone()) is not None:
            out.append(r)
        return out

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._rows]

    def close(self) -> None:
        self._rows = None


class Connection:
    def __init__(self, session: Session):
        self.session = session

    def cursor(self) -> Cursor:
        return Cursor(self.session)

    def commit(self) -> None:
        if self.session._stack:
            self.session.execute("COMMIT")

    def rollback(self) -> None:
        if self.session._stack:
            self.session.execute("CANCEL")

    def close(self) -> None:
        pass


def connect(session: Session) -> Connection:
    return Connection(session)
