import pickle
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaica.llm import decontaminate as d

from ..oracle import compare, connect
from .helpers import awkward, docs, key


def brute(text_words, items, window):
    hit, names = set(), set()
    for name, words in items:
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            for j in range(len(text_words) - n + 1):
                if text_words[j : j + n] == words[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add(name)
    return hit, names


words = st.lists(st.sampled_from([b"a", b"b", b"c", b"z"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(st.lists(words, max_size=4), st.lists(words, max_size=5), st.integers(1, 5), st.integers(1, 9))
def test_automaton(texts, items, window, stretch):
    named = [(f"i{k}" if k else None, w) for k, w in enumerate(items)]
    automaton, d.STRETCH = pickle.loads(pickle.dumps(d.Automaton(named, window))), stretch
    try:
        got = automaton.scan_all(texts)
    finally:
        d.STRETCH = 512
    for text, (spans, found) in zip(texts, got, strict=True):
        hit, names = brute(text, named, window)
        assert {p for a, b in spans for p in range(a, b)} == hit
        assert found == sorted(names, key=lambda x: (x is None, x or ""))
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_automaton_is_small_and_quick():
    r = random.Random(1)
    vocabulary = [f"w{i}".encode() for i in range(20_000)]
    text = [r.choice(vocabulary) for _ in range(50_000)]
    began = time.perf_counter()
    automaton = d.Automaton([("x", text)])
    assert time.perf_counter() - began < 10 and len(pickle.dumps(automaton)) < 100 * len(text)
    assert automaton.scan(text[40_000:40_500] + [b"other"])[0] == [(0, 500)]


def test_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "a b"), (None, "c d"), ("x", "a b")], "item_id string, text string")
    got = {r.doc_id: r for r in d.contamination(docs(spark, [(1, "a b c d"), (2, "c d"), (3, "b c")]), bench).collect()}
    assert (got[1].n_hit, got[1]["items"]) == (4, ["x", None]) and (got[2].n_hit, got[2]["items"]) == (2, [None]) and (got[3].n_hit, got[3]["items"]) == (0, [])


def test_words():
    assert d.normalised("It's ÄÖ-x_1 日本") == ["it".encode(), b"s", "ÄÖ".encode(), b"x", b"1", "日本".encode()]
    assert d.normalised(None) == []


def test_several_blocks(spark):
    bench = spark.createDataFrame([(f"i{k}", " ".join(f"w{k}_{j}" for j in range(15))) for k in range(40)] + [("none", None), (None, "a b"), ("short", "alpha beta")], "item_id string, text string")
    rows = [(k, f"x y w{k}_2 " + " ".join(f"w{k}_{j}" for j in range(1, 13)) + " alpha beta end") for k in range(0, 40, 5)] + [(99, "clean text"), (100, None)]
    one = sorted((tuple(r) for r in d.contamination(docs(spark, rows), bench).collect()), key=key)
    many = sorted((tuple(r) for r in d.contamination(docs(spark, rows), bench, block_words=100).collect()), key=key)
    assert one == many and len(one) == len(rows)
    by = {r[0]: r for r in one}
    assert by[5][2] == 26 and by[5][3] == ["i5", "short"] and by[99][2] == 0


def test_removal(spark):
    bench = spark.createDataFrame([("i", " ".join(f"q{j}" for j in range(12)))], "item_id string, text string")
    passage = " ".join(f"Q{j}," for j in range(12))
    rows = [(1, "Keep this. " + "more words here " * 10 + passage + " and that."), (2, passage + " two"), (3, "clean"), (4, None)]
    got = {r.doc_id: r for r in d.decontaminate(docs(spark, rows), bench).collect()}
    assert set(got) == {1, 3, 4} and got[1].text.startswith("Keep this. more") and got[1].text.endswith("here , and that.") and "Q5" not in got[1].text
    assert got[1].n_chars == len(got[1].text) and got[3].text == "clean" and got[4].text is None


def test_several_blocks_remove_what_one_does(spark):
    passage = lambda k, n=12: " ".join(f"w{k}_{j}" for j in range(n))
    overlap = [(f"o{k}", " ".join(f"v{j}" for j in range(k * 6, k * 6 + 12))) for k in range(6)]
    bench = spark.createDataFrame([(f"i{k}", passage(k)) for k in range(40)] + overlap, "item_id string, text string")
    free = lambda n: " ".join(f"f{j}" for j in range(n))
    rows = [(k, f"{passage(k)} {free(16)} {passage(k + 1)}") for k in range(0, 40, 2)]  # 24 of 40 words
    rows += [(50, f"{free(99)} {' '.join(f'v{j}' for j in range(42))} end"), (51, f"w0_0 w0_1 w0_2 {passage(1)} {' '.join(f'w0_{j}' for j in range(3, 12))} {free(60)}"), (52, free(20)), (53, None), (None, passage(3)), (None, free(5))]
    df = docs(spark, rows).withColumns({"_row": F.lit("x"), "_spans": F.lit(1)})
    one = sorted((tuple(r) for r in d.decontaminate(df, bench).collect()), key=key)
    many = d.decontaminate(df, bench, block_words=30)
    assert many.columns == df.columns and sorted((tuple(r) for r in many.collect()), key=key) == one
    assert {r[0] for r in one} == {50, 51, 52, 53, None} and len(one) == 5


def test_awkward(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    df = awkward(spark)
    assert d.contamination(df, bench).count() == df.count() and d.decontaminate(df, bench).columns == df.columns
    assert d.contamination(df.limit(0), bench).count() == 0 and d.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_whole_table(spark, sf):
    compare(d.op6_decontamination(spark, sf), connect(sf), d.OP6_SQL)
