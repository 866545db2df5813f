import numpy as np
import pytest

from mosaica.llm import knn

from ..oracle import compare, connect

SCHEMA = "vec_id long, embedding array<float>, key string, rank int"


def brute(rows, every, k):
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % every == 0 and (i not in queries or v.tolist() < queries[i].tolist()):
            queries[i] = v
    out = []
    for i, q in queries.items():
        near = sorted((-int(q @ x), j) for j, x in good if j != i and len(x) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def run(spark, rows, every, k, **kw):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in knn.top_k(df, every, k, **kw).select("query_id", "rank", "vec_id", "score").collect())


def vectors(n, d, seed, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in r.normal(size=d) * scale]) for i in range(n)]


@pytest.mark.parametrize("n, d, every", [(300, 8, 7), (40, 3, 1), (5, 2, 1)])
def test_exact(spark, n, d, every):
    rows = vectors(n, d, n)
    assert run(spark, rows, every, 10) == brute(rows, every, 10)


def test_cells_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 9)
    rows = vectors(200, 4, 1) + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]
    assert run(spark, rows, 10, 10, max_pivots=6, sample=40, least_block=16) == brute(rows, 10, 10)


def test_clusters_are_pruned(spark):
    """Of the pairs of queries and blocks few are solved where the data have clusters; the answers stay exact."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16)) * 4
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + r.normal(size=16) * 0.1]) for i in range(2000)]
    report = {}
    assert run(spark, rows, 50, 10, sample=400, least_block=32, report=report) == brute(rows, 50, 10)
    share = report["pairs"] / (report["queries"] * report["blocks"])
    print("pairs solved:", share)
    assert share < 0.2 and report["queries"] == 40 and report["blocks"] >= 20


def test_awkward_vectors(spark):
    rows = vectors(30, 4, 2) + [(100, None), (110, []), (120, [1.0, None, 2.0, 3.0]), (130, [float("nan")] * 4), (140, [float("inf"), 0.0, 0.0, 0.0]), (150, [1.0, 2.0]), (160, [2.0, 1.0]), (None, [1.0] * 4), (170, [9.0] * 4), (170, [9.0] * 4), (170, [8.0] * 4)]
    assert run(spark, rows, 10, 10) == brute(rows, 10, 10)
    assert run(spark, [(1, None)], 1, 10) == []


def test_large_components_stay_exact():
    q = np.array([[2.0**30, 1.0]])
    assert knn._exact(q, q)[0, 0] == 2**60 + 1
    with pytest.raises(OverflowError):
        knn._exact(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_whole_table(spark, sf):
    compare(knn.op5_topk(spark, sf), connect(sf), knn.OP5_SQL)
