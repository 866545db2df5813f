import hashlib
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaica.llm import common, rolling, similarity, substrings
from mosaica.llm.components import components
from mosaica.sources import storage

from ..oracle import compare, connect
from .helpers import awkward, docs, key


# ---------------------------------------------------------------- hashes
@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 40))
def test_windows_hash_alike_where_words_are_alike(words, width):
    h = rolling.word_hashes([str(w).encode() for w in words])
    got = rolling.windows(h, width)
    want = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    assert len(got) == len(want)
    assert len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 24), st.sampled_from([4, 8]))
def test_dealt_lists_come_back(values, top, width):
    deal = rolling.Deal(1 << top, width)
    keys = np.unique(deal.cut(np.array(sorted(values), np.uint64)))
    parts = list(deal.split(keys))
    got = [deal.unpack(p, deal.pack(p, keys[s])) for p, s in parts]
    assert (np.concatenate(got) if got else keys).tolist() == keys.tolist()
    assert [p for p, _ in parts] == sorted({p for p, _ in parts}) and all(p < 1 << top for p, _ in parts)
    assert len(pickle.dumps(deal)) < 500


def test_rows_exchanged_grow_in_proportion():
    """Chunks times parts is what a pass exchanges in rows: for 16 times the text, 16 times as many at most (parts are powers of two), and
    at a terabyte still more than a hundred hashes a row."""
    for chars in (10**8, 3 * 10**8, 5 * 10**8):
        (c1, p1), (c2, p2) = rolling.sizes(chars), rolling.sizes(16 * chars)
        assert c2 * p2 / (c1 * p1) <= 40
    chunks, parts = rolling.sizes(10**12)
    assert 10**12 / 6 / (chunks * parts) > 100
    assert all(rolling.sizes(n)[0] >= 1 and rolling.sizes(n)[1] >= 64 for n in (0, 1, 10**6, 10**14))


def test_equal_rows_are_spread_over_chunks(spark, tmp_path):
    spark.range(0, 200_000, 1, 4).selectExpr("if(id % 2 = 0, null, id) AS doc_id", "if(id % 2 = 0, 'one and the same', 'text ' || id) AS text").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d")).select("doc_id", "text")
    assert common.from_files(df) and not common.from_files(df.distinct()) and not common.from_files(df.join(df.limit(3), "doc_id", "left_semi"))
    sizes = sorted(r["count"] for r in rolling.chunked(df, 40).groupBy("chunk").count().collect())
    assert len(sizes) == 40 and sizes[-1] < 3 * sizes[20]


def test_inside():
    ok = rolling.inside(np.array([3, 0, 4, 1]), 3)
    assert np.flatnonzero(ok).tolist() == [0, 3, 4]


# ---------------------------------------------------------------- substrings
def brute_repeats(rows, window):
    words = [(i, (t or "").split(" ") if t else []) for i, t in rows]
    words = [(i, [w for w in ws if w]) for i, ws in words]
    seen = Counter(tuple(ws[i : i + window]) for _, ws in words for i in range(len(ws) - window + 1))
    out = []
    for doc, ws in words:
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window", [35, 5, 2, 1])
def test_repeats(spark, window):
    r = random.Random(window)
    fresh = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared = [fresh(60) for _ in range(4)]
    rows = [(i, f"{fresh(r.randrange(80))} {r.choice(shared)[r.randrange(40) :]} {fresh(r.randrange(30))}") for i in range(40)]
    rows += [(100, shared[0]), (101, shared[0]), (102, fresh(34)), (103, " ".join(["la"] * 90)), (104, fresh(20) + " " + shared[1] + " " + shared[1]), (105, None), (106, "")]
    got = sorted((tuple(x) for x in substrings.repeats(docs(spark, rows), window).collect()), key=key)
    assert got == brute_repeats(rows, window)


def test_repeats_awkward(spark):
    df = awkward(spark)
    got = substrings.repeats(df, with_text=True).collect()
    assert len(got) == df.count()
    assert {r.doc_id: r.n_removed for r in got}[5] == 30_000
    assert substrings.repeats(df.limit(0)).count() == 0


def test_repeats_whole_table(spark, sf):
    compare(substrings.op4_substring_dedup(spark, sf), connect(sf), substrings.OP4_SQL)


# ---------------------------------------------------------------- similarity
def brute_components(rows):
    sets = []
    for i, t in rows:
        ws = [w for w in (t or "").lower().split()]
        sets.append((i, {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)].append(i)
    return sorted(((i, len(s), min((x for x in least[find(a)] if x is not None), default=None)) for a, (i, s) in enumerate(sets)), key=key)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_components_against_all_pairs(spark, seed):
    r = random.Random(seed)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, i = [], 0
    for size in (1, 2, 3, 30, 60):
        base = fresh(r.choice((12, 60, 120, 146)))
        for _ in range(size):
            rows.append((i := i + 1, edited(r, base, r.randrange(9))))
    line = fresh(50)
    rows += [(i := i + 1, " ".join(line + fresh(r.randrange(25)))) for _ in range(40)]
    chain = fresh(100)
    for k in range(12):  # neighbours are alike, ends are not
        rows.append((i := i + 1, " ".join(chain[4 * k : 4 * k + 60])))
    rows += [(i := i + 1, rows[5][1]), (i := i + 1, rows[5][1].upper()), (i := i + 1, "one two"), (i := i + 1, "one two"), (i := i + 1, "one  TWO "), (i := i + 1, "two one"), (i := i + 1, None), (i := i + 1, "")]
    r.shuffle(rows)
    got = sorted((tuple(x) for x in similarity.near_duplicates(docs(spark, rows)).collect()), key=key)
    assert got == brute_components(rows)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.data())
def test_similar_sets_match_in_their_prefixes(x, y, data):
    df = {t: data.draw(st.integers(2, 40), label=str(t)) for t in sorted(x | y)}
    if 100 * len(x & y) < 80 * len(x | y):
        return
    posted = []
    for s in (x, y):
        own = np.array(sorted(s), np.uint64)
        need, places, levels = similarity.prefix(own, np.array([df[t] for t in sorted(s)]))
        posted.append((need, {int(own[p]): int(level) for p, level in zip(places, levels, strict=True)}))
    need = min(posted[0][0], posted[1][0])
    both = [t for t in posted[0][1] if t in posted[1][1] and max(posted[0][1][t], posted[1][1][t]) <= need]
    assert len(both) >= need


def test_similarity_awkward(spark):
    df = awkward(spark)
    got = sorted((tuple(r) for r in similarity.near_duplicates(df).collect()), key=key)
    assert got == brute_components([(r.doc_id, r.text) for r in df.collect()])
    assert similarity.near_duplicates(df.limit(0)).count() == 0


def test_similarity_whole_table(spark, sf):
    compare(similarity.op9_jaccard_join(spark, sf), connect(sf), similarity.OP9_SQL)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 5), (3, 4), (4, 3), (None, 2), (9, -7), (-7, 100)]])
def test_components(spark, edges):
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if x is not None}
    for _ in edges:
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert got == {(x, label[x]) for x in linked}


def test_components_of_links_that_come_later(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k + 100, k + 101) for k in range(20)]
    r.shuffle(edges)
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = None
    for some in (edges[:30], [], edges[30:50], edges[:10], edges[50:]):
        known = components(table(some), known=known)
    got = [tuple(x) for x in known.collect()]
    assert sorted(got) == sorted(tuple(x) for x in components(table(edges)).collect())
    assert len(got) == len({x for a, b in edges if a != b for x in (a, b)})


def test_links_of_earlier_rounds_are_not_followed_again(spark):
    """The driver holds plans, threads and compiled code for each statement, so their number is kept down."""
    r = random.Random(5)
    base = [[f"w{r.randrange(10**6)}" for _ in range(100)] for _ in range(6)]
    rows = [(10 * k + i, edited(r, words, 2)) for k, words in enumerate(base) for i in range(8)]
    before = set(storage.written(spark))
    got = sorted((tuple(x) for x in similarity.near_duplicates(docs(spark, rows)).collect()), key=key)
    assert got == brute_components(rows)
    assert len([p for p in storage.written(spark) if p not in before]) <= 28


def test_many_equal_rows(spark):
    """Thousands of rows that repeat id and text: all their words go, and they are one component."""
    same, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    df = docs(spark, [(None if i % 3 else 5, same) for i in range(3000)] + [(7, other), (8, "short")])
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.repeats(df).collect())
    assert got == Counter({(None, 40, 40): 2000, (5, 40, 40): 1000, (7, 40, 0): 1, (8, 1, 0): 1})
    found = Counter(tuple(r) for r in similarity.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect())
    assert found == Counter({(None, 36, 5): 2000, (5, 36, 5): 1000, (7, 36, 7): 1, (8, 1, 8): 1})
