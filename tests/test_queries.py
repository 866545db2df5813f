import math

import pytest

from mosaica import queries as q

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [k for k, r in q.REGISTERED.items() if r.sql])
def test_query_gives_the_rows_of_its_sql(spark, sf, con, name):
    compare(q.REGISTERED[name].run(spark, sf), con, q.REGISTERED[name].sql)


def test_distance_join_over_all_customers(spark, sf):
    at = {k: ((k * 37 % 360) - 180, (k * 17 % 170) - 85) for (k,) in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}

    def metres(p, r):
        (x, y), (u, v) = (tuple(map(math.radians, z)) for z in (p, r))
        return 2 * 6371008.8 * math.asin(math.sqrt(min(1.0, math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))

    want = sorted((a, b) for a in at for b in at if metres(at[a], at[b]) < 300_000)
    assert len(want) > len(at) and sorted(tuple(r) for r in q.REGISTERED["geo_distance_join"].run(spark, sf).collect()) == want


def test_highlight_marks_the_whole_text(spark, sf):
    out = q.REGISTERED["highlight"].run(spark, sf).collect()
    assert out and all("<b>" in r.h for r in out)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
