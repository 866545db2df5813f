import itertools

import pytest
from pyspark.sql import functions as F

from mosaica import semantics as sem
from mosaica.plans.expressions import Rows, lower
from mosaica.lang import parse_expression

GRID = [None, -2, 0, 1, 7]
TEXTS = [None, "", "1", "7", "x"]


def order(a, b):
    """Missing below all; then by value."""
    return (a is not None, a if a is not None else 0) < (b is not None, b if b is not None else 0)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(itertools.product(GRID, GRID)), "a long, b long")


@pytest.mark.parametrize(
    "op, want",
    [("=", lambda a, b: a == b), ("!=", lambda a, b: a != b), ("<", order), (">", lambda a, b: order(b, a)), ("<=", lambda a, b: not order(b, a)), (">=", lambda a, b: not order(a, b))],
)
def test_comparisons_have_two_values(pairs, op, want):
    rows = Rows(pairs)
    got = pairs.select("a", "b", lower(parse_expression(f"a {op} b"), rows).col.alias("r")).collect()
    assert [(r.a, r.b, r.r) for r in got] == [(r.a, r.b, want(r.a, r.b)) for r in got]


@pytest.mark.parametrize("c", [-2, 0, 3])
@pytest.mark.parametrize("op, want", [("=", lambda a, b: a == b), ("<", order), (">", lambda a, b: order(b, a)), ("<=", lambda a, b: not order(b, a)), (">=", lambda a, b: not order(a, b)), ("!=", lambda a, b: a != b)])
def test_comparisons_with_literals(pairs, op, want, c):
    for left in (True, False):
        text = f"a {op} {c}" if left else f"{c} {op} a"
        got = pairs.select("a", lower(parse_expression(text), Rows(pairs)).col.alias("r")).collect()
        assert all(r.r is want(*((r.a, c) if left else (c, r.a))) for r in got), text


def test_numbers_and_texts(spark):
    df = spark.createDataFrame(list(itertools.product(GRID, TEXTS)), "a long, s string")
    got = df.select("a", "s", lower(parse_expression("a = s"), Rows(df)).col.alias("r"), lower(parse_expression("a == s"), Rows(df)).col.alias("t")).collect()
    for r in got:
        number = int(r.s) if r.s and r.s.isdigit() else None
        assert r.t is (r.a is None and r.s is None)
        assert r.r is (r.a == number)


def test_truth(spark):
    one = spark.range(1)
    for text, want in {"1": True, "0": False, "''": False, "'0'": True, "null": False, "[]": False, "[0]": True, "{}": False, "{a: 1}": True, "1h": True, "0.0": False, "true": True}.items():
        assert one.select(sem.truthy(lower(parse_expression(text), Rows(one))).alias("t")).first().t is want, text


def test_arithmetic(spark):
    one = spark.range(1)
    value = lambda text: one.select(lower(parse_expression(text), Rows(one)).col.alias("v")).first().v
    assert value("null + 5") == 10 and value("null * 5") == 25 and value("null - 5") == 0
    assert str(value("10 / 3")) == "3.3333333333"
    assert value("7 % 4") == 3 and value("2 ** 10") == 1024.0 and value("1 / 0") is None
    assert value("'a' + 1") == "a1" and value("1.5 + 1") == 2.5
    assert str(value("d'2024-01-01T00:00:00Z' + 1d12h")) == "2024-01-02 12:00:00"


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    rows = Rows(df)
    from mosaica.plans.expressions import condition

    plan = df.where(condition(parse_expression("o_totalprice > 1000.0 and o_orderstatus = 'F'"), rows)).select("o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), EqualNullSafe(o_orderstatus,F), GreaterThan(o_totalprice,1000.0)]" in plan or ("GreaterThan(o_totalprice,1000.0)" in plan and "o_orderstatus,F)" in plan)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_rank_orders_types():
    from pyspark.sql import types as T

    kinds = [T.NullType(), T.BooleanType(), T.LongType(), T.StringType(), T.DayTimeIntervalType(), T.TimestampType(), T.ArrayType(T.LongType()), T.StructType(), T.BinaryType()]
    assert [sem.rank(k) for k in kinds] == sorted(sem.rank(k) for k in kinds)
    assert F is not None
