"""Dump and restore: definitions as statements of the language, rows as Parquet or JSON on any Hadoop file system.

Rows are written and read by executors; the driver handles definitions alone. Key-value entries and users are not dumped."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lang.render import render
from .tables import State

_KEPT = ("analyzer", "table", "field", "index", "event", "data rule")


def statements(session) -> list[str]:
    """The definitions of the database in use, in an order in which they can run."""
    found = [d for (what, _), d in session.definitions.items() if what in _KEPT]
    return [render(d) for d in sorted(found, key=lambda d: _KEPT.index(d.what))]


def dump(session, path: str, form: str = "parquet") -> list[str]:
    """Writes all tables, edges and definitions under path; the names of the tables written."""
    names = []
    for name in sorted(session.tables):
        df = session.tables[name].rows()
        if df is not None:
            df.write.mode("overwrite").format(form).save(f"{path}/tables/{name}")
            names.append(name)
    spark = session.spark
    if session.edges is not None or session.related is not None:
        session._edges().write.mode("overwrite").format(form).save(f"{path}/edges")
    lines = [(i, s) for i, s in enumerate(statements(session))]
    spark.createDataFrame(lines, "n int, statement string").coalesce(1).write.mode("overwrite").json(f"{path}/definitions")
    spark.createDataFrame([(x,) for x in names], "name string").coalesce(1).write.mode("overwrite").json(f"{path}/names")
    return names


def restore(session, path: str, form: str = "parquet") -> list[str]:
    """Reads what dump() has written into the database in use."""
    spark = session.spark
    for r in spark.read.schema("n int, statement string").json(f"{path}/definitions").orderBy("n").collect():
        session.execute(r.statement)
    names = [r.name for r in spark.read.schema("name string").json(f"{path}/names").collect()]
    for name in names:
        t = session._own(name)
        t.write(State(spark.read.format(form).load(f"{path}/tables/{name}")))
    try:
        edges = spark.read.format(form).load(f"{path}/edges")
    except Exception as e:  # a dump without edges
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return names
    session.register_edges(edges)
    return names


def script(session, most: int = 10_000) -> str:
    """Definitions and rows of small tables as one text of statements: DEFINE ... and INSERT ...; refuses tables beyond ``most`` rows."""
    out = statements(session)
    for name in sorted(session.tables):
        df = session.tables[name].rows()
        if df is None:
            continue
        rows = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("j")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows; use dump()")
        if rows:
            out.append(f"INSERT INTO {name} [{', '.join(r.j for r in rows)}]")
    return ";\n".join(out)


__all__ = ["dump", "restore", "script", "statements"]
