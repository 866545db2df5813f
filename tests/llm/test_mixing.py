import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as p
from mosaica.llm import mixing as m

from ..oracle import compare, connect
from .helpers import SCHEMA, awkward


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 60), min_size=1, max_size=8))
def test_schedule_deviates_by_less_than_a_block(q):
    Q, plan, done = sum(q.values()), m.schedule(q), dict.fromkeys(q, 0)
    assert len(plan) == Q
    for t, (s, b) in enumerate(plan):
        assert b == done[s] and b * Q // q[s] <= t < -(-(b + 1) * Q // q[s])
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * q[x] / Q) < 1 for x in q)


@pytest.mark.parametrize("weights", [{"a": 7, "b": 3.00031}, {"a": 10**6, "b": 1}, {"a": 0.1, "b": 0.2, "c": 0.7}, {"a": Fraction(1, 3), "b": Fraction(1, 7), "c": 2}])
def test_no_drift_from_the_true_weights(weights):
    """Over 10^7 slots and beyond, against the weights as given: the period is exact, so nothing adds up."""
    q = m.exact(weights)
    total, Q = sum(Fraction(str(w)) if isinstance(w, float) else Fraction(w) for w in weights.values()), sum(q.values())
    share = {s: (Fraction(str(w)) if isinstance(w, float) else Fraction(w)) / total for s, w in weights.items()}
    assert all(share[s] == Fraction(q[s], Q) for s in q)
    plan, done, worst = m.schedule(q), dict.fromkeys(q, 0), 0.0
    for t, (s, _) in enumerate(plan):
        done[s] += 1
        worst = max(worst, *(abs(done[x] - (t + 1) * q[x] / Q) for x in q))
    assert worst < 1 and done == q
    for t in (10**7, 10**7 + 123_457, 10**9 + 1):  # whole periods are exact, so the rest is a place in the first one
        first = plan[: t % Q]
        assert all(abs(t // Q * q[x] + sum(s == x for s, _ in first) - t * share[x]) < 1 for x in q)


def test_exact():
    assert m.exact({"a": 1, "b": 3}) == {"a": 1, "b": 3} and m.exact({"a": 0.5, "b": 0.25, "c": 0.0}) == {"a": 2, "b": 1}
    assert m.exact({}) == {} and m.exact({"a": 0}) == {}
    with pytest.raises(ValueError):
        m.exact({"a": -1})


def test_periods_beyond_the_bound_are_refused(spark):
    df = spark.createDataFrame([(1, "x", "en", "a", 1), (2, "y", "en", "b", 1)], SCHEMA)
    with pytest.raises(ValueError, match="slots"):
        m.plan_mix(df, {"a": 1, "b": m.MAX_PERIOD})


def test_weights_of_sizes():
    assert m.natural({"a": 3 << 40, "b": 1 << 40, "c": 0}) == {"a": 49152, "b": 16384, "c": 1}
    assert m.tempered({"a": 900, "b": 100}) == {"a": 750, "b": 250} and m.tempered({"a": 0}) == {"a": 1}


def brute(rows, weights, block):
    by = defaultdict(list)
    for r in rows:
        by[r.source or ""].append(r)
    sizes = {s: sum(len(r.text or "") for r in v) for s, v in by.items()}
    q = m.exact({s: w for s, w in (weights or m.natural(sizes)).items() if s in sizes})
    Q = sum(q.values())
    slot = {sb: t for t, sb in enumerate(m.schedule(q))}
    place = lambda s, b: b // q[s] * Q + slot[s, b % q[s]]
    end = min(place(s, max(1, -(-sizes[s] // block))) for s in q)
    out = []
    for s, v in by.items():
        at = 0
        for r in sorted(v, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest() if r.doc_id is not None else "", len(r.text or ""), r.doc_id or 0)):
            b = at // block
            out.append((r.doc_id, s, b, place(s, b) if s in q else None, s in q, s in q and place(s, b) < end))
            at += len(r.text or "")
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "source", "block", "slot", "taken", "held").collect()), key=str)


@pytest.mark.parametrize("weights", [None, {"s0": 1, "s1": 1}, {"s0": 0.7, "s2": 0.2, "s3": 0.1, "unknown": 5.0}])
def test_plan(spark, weights, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 8)
    r = random.Random(5)
    rows = [(i, "x" * r.randrange(300), "en", f"s{min(3, r.randrange(8))}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(m.plan_mix(df, weights, block_chars=200)) == brute(df.collect(), weights, 200)
    only = m.plan_mix(df, weights, block_chars=200, whole=False)
    assert only.where("taken <> held").count() == 0 and 0 < only.where("taken").count() < 300 + (weights is None)


def test_repeated_and_null_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 8)
    r = random.Random(6)
    rows = [(r.choice([7, None, i]), "x" * r.choice([5, 5, 5, r.randrange(300)]), "en", f"s{min(1, r.randrange(4))}", 0) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(m.plan_mix(df, block_chars=200)) == brute(df.collect(), None, 200)


def test_mix_takes_what_is_planned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id for r in m.plan_mix(docs).where("taken").collect()}
    out = m.mix(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == taken and 0 < len(taken) <= docs.count()


def test_a_tiny_source_does_not_end_the_mix(spark):
    rows = [(i, "x" * 100, "en", f"s{i % 3}", 100) for i in range(900)] + [(900, "x" * 100, "en", None, 100)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = m.plan_mix(df, block_chars=100)
    assert plan.where("taken").count() == 901
    place = {r.doc_id: (r.slot, hashlib.md5(str(r.doc_id).encode()).hexdigest()) for r in plan.collect()}
    assert [r.doc_id for r in m.mix(df, block_chars=100).collect()] == sorted(place, key=place.get)
    assert p.mix_sources(spark, df, "").count() == 901


def test_a_hot_source_is_taken_whole_and_spread_to_the_end(spark):
    rows = [(i, "x" * 100, "en", "hot" if i % 2 else f"s{i % 20}", 100) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = m.plan_mix(df, block_chars=100).where("taken").orderBy("slot").collect()
    assert len(plan) == 2000
    assert all(80 < sum(r.source == "hot" for r in plan[a : a + 200]) < 120 for a in range(0, 2000, 200))


def test_native(spark, sf):
    plan = m.op3_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))


def test_awkward(spark):
    df = awkward(spark)
    assert m.plan_mix(df).count() == df.count() and m.mix(df).columns == df.columns
    assert m.plan_mix(df.limit(0)).count() == 0 and m.mix(df.limit(0)).count() == 0


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(m, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        m.plan_mix(awkward(spark))


def test_whole_table(spark, sf):
    compare(m.op3_mixing(spark, sf), connect(sf), m.OP3_SQL)
