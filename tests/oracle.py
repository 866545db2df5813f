"""Rows of a DataFrame against rows of DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict(recursive=True).items()}
    return v


def rows(df):
    names = sorted(df.columns)
    return names, sorted(str([plain(v) for v in r]) for r in df.select(*(f"`{n}`" for n in names)).collect())


def sql_rows(con, sql):
    names = sorted(con.sql(sql).columns)
    return names, sorted(str([plain(v) for v in r]) for r in con.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({sql.strip()}) q").fetchall())


def compare(df, con, sql):
    assert rows(df) == sql_rows(con, sql)
