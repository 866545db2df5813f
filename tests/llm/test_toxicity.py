import itertools
import os
import zlib

import numpy as np
import pytest

from mosaica.llm import toxicity as t

from .helpers import awkward


def test_marginals_against_all_paths():
    m = t.Tagger()
    m.A, m.s = np.array([[0.7, -0.4], [0.2, 0.9]]), np.array([0.1, -0.3])
    e = np.array([0.5, -1.0, 2.0, 0.3])
    weight = {p: np.exp(m.s[p[0]] + sum(e[i] * y for i, y in enumerate(p)) + sum(m.A[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product((0, 1), repeat=4)}
    z = sum(weight.values())
    want = [sum(w for p, w in weight.items() if p[i]) / z for i in range(4)]
    seq = np.full((1, t.SEQUENCE), -1)
    seq[0, :4] = range(4)
    p, pairs, _ = m.marginals(e, seq, pairs=True)
    assert p == pytest.approx(want)
    assert pairs[1, 0] == pytest.approx(sum(w * sum(a == 1 and b == 0 for a, b in itertools.pairwise(p)) for p, w in weight.items()) / z)


def test_features_are_of_the_word(monkeypatch):
    ((slots, sizes),) = t.features(["abc", "héllo", "abc"])
    assert sizes.tolist() == [1 + 3 + 2 + 1, 1 + 5 + 4 + 3, 7] and sorted(slots[:7]) == sorted(slots[-7:])
    monkeypatch.setattr(t, "WORDS", 2)
    w = np.random.default_rng(1).normal(size=t.SLOTS)
    assert t.summed(w, t.features(["abc", "héllo", "abc"])) == pytest.approx([w[slots[:7]].sum(), w[slots[7:20]].sum(), w[slots[:7]].sum()])
    assert t.features([]) == [] and t.summed(w, []).size == 0


def test_sequences_cover_each_word_once():
    lengths = np.array([0, 1, 127, 128, 129, 300])
    seq = t.chunks(lengths)
    assert sorted(seq[seq >= 0].tolist()) == list(range(lengths.sum()))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    assert all(len(set(doc[r[r >= 0]])) == 1 for r in seq)


def corpus(n, seed):
    r = np.random.default_rng(seed)
    clean = [f"{a}{b}{c}" for a in ("ta", "mo", "ri") for b in ("la", "ne", "so") for c in ("", "ka", "du")]
    out = []
    for _ in range(n):
        toxic = int(r.random() < 0.25)
        words = [str(r.choice(clean)) for _ in range(int(r.integers(5, 80)))]
        for _ in range(3 * toxic):
            words.insert(int(r.integers(len(words))), str(r.choice(["grumph", "zorkle", "vexnar"])))
        out.append((" ".join(words), toxic))
    return out


def test_held_out_accuracy():
    m = t.fit(*zip(*corpus(400, 1), strict=True))
    texts, labels = zip(*corpus(200, 2), strict=True)
    scores, marginals = t.tag(list(texts), m)
    assert ((scores >= 0.5) == np.array(labels)).mean() > 0.97
    words = [w for x in texts for w in t.tokens(x)]
    marked = {w for w, p in zip(words, np.concatenate(marginals), strict=True) if p > 0.5}
    assert marked == {"grumph", "zorkle", "vexnar"}


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1], [0, 1]])
def test_few_labels(labels):
    scores, _ = t.tag(["a b", None, ""], t.fit(["x y"] * len(labels), labels))
    assert np.isfinite(scores).all() and ((scores >= 0) & (scores <= 1)).all()


def test_spans_and_awkward_rows(spark):
    m = t.fit(*zip(*corpus(400, 1), strict=True))
    df = spark.createDataFrame([(1, "talaka GRUMPH, vexnar talaka"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in t.score_documents(df, m).collect()}
    assert [(s.start, s.stop) for s in got[1].spans] == [(7, 13), (15, 21)] and got[1].score > 0.5 > got[2].score
    assert [r.doc_id for r in t.drop_toxic(df, m).collect()] == [2]
    a = awkward(spark)
    assert t.score_documents(a, m).count() == a.count() == t.drop_toxic(a, m).count() and t.score_documents(a.limit(0), m).count() == 0


def test_held_out_labels_are_not_seen(spark, sf):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    texts, toxic, odds = t.labelled_sample(docs, labels, most=60)
    ids = [int(x.split()[1]) for x in texts]
    assert len(ids) == 60 and sum(toxic) == 30 and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and 0.8 < odds < 1.25
    got = t.op7_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_the_sample_is_bounded_and_the_same_however_rows_come(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(1, 0), (2, 1), (None, 1), (3, 7)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(100)] + [(4, "a"), (4, None), (6, "y" * 500), (None, "none")], "doc_id long, text string")
    one = t.labelled_sample(docs, labels)
    assert t.labelled_sample(docs.orderBy("text").repartition(7), labels.repartition(5)) == one
    by = dict(zip(one[0], one[1], strict=True))
    assert by["xx"] == 1 and by["xxx"] == 1 and by["a"] == 0 and "none" not in by  # contradictory labels: toxic; several texts: the smallest
    few = t.labelled_sample(docs, labels, chars=1600)
    assert 0 < sum(map(len, few[0])) <= 1600 and max(map(len, few[0])) <= 100 and set(few[0]) < set(one[0])


def test_the_whole_query(spark, sf):
    """Against the model applied to each text by itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    m = t.trained(spark, sf)
    want = {r.doc_id: t.tag([r.text], m)[0][0] for r in docs}
    got = {r.doc_id: r for r in t.op7_toxicity(spark, sf).collect()}
    assert set(got) == set(want) and all(got[i].score == pytest.approx(want[i], abs=1e-9) for i in want)


LARGE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no larger table")
def test_recall_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text").collect() if r.doc_id in labels}
    scores = t.tag(list(docs.values()), t.trained(spark, LARGE))[0]
    toxic, said = np.array([labels[i] for i in docs]) == 1, scores >= 0.5
    assert (said & toxic).sum() / toxic.sum() >= 0.9 and (said & ~toxic).sum() / (~toxic).sum() <= 0.01
    print("held out:", int((said & toxic).sum()), "of", int(toxic.sum()), "; clean:", int((said & ~toxic).sum()), "of", int((~toxic).sum()))
