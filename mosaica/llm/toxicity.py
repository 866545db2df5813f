"""Toxicity: a linear-chain conditional random field over words tags toxic spans; marginals are pooled to document scores.

Labels are of documents, so tokens are labelled by weak supervision first: in a document labelled toxic, a word is toxic whose
identity or character n-grams are found in labelled toxic documents far more often than in clean ones (a lower confidence
bound of the log odds decides); words of clean documents are clean. The CRF has two tags; its emissions are hashed features
(word identity, character 3- to 5-grams with word ends), its transitions are learned, and sequences are 128 consecutive words. A
logistic layer, fitted on labelled documents that the CRF did not see, turns pooled marginals into the score.

Fitting uses a bounded sample: at most ``MAX_LABELLED`` labelled documents (those with the smallest hash of doc_id, drawn alike
from both labels) of ``MAX_LABELLED_CHARS`` characters in all, whole texts each; and of their sequences without a toxic word at
most ``CLEAN_SEQUENCES``, or ``CLEAN_RATIO`` times those with one. Scoring is a map over all documents without exchange.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_LABELLED = 4000
MAX_LABELLED_CHARS = 16_000_000  # of the sample; a text of more than a sixteenth of that is not drawn
CLEAN_SEQUENCES, CLEAN_RATIO = 2000, 4
SEQUENCE = 128
SLOTS = 1 << 19  # of the hashed weights
CHARS = 1_500_000  # of texts that are worked on at once
ITERATIONS, CALIBRATION = 45, 0.25
THRESHOLD = 0.5
LEAST = 0.05  # marginal from which a word counts for its document
SURE = 1.5  # lower bound of the log odds of a feature that labels tokens
REGULAR = 4.0  # of the weights: the curvature of their prior

_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1000003)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


WORDS = 40_000  # of a vocabulary whose features are made at once


def features(vocabulary: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots of the features of every word (identity, 3- to 5-grams of ^word$), in blocks of words: (slots by word, features of each word)."""
    return [_features(vocabulary[at : at + WORDS]) for at in range(0, len(vocabulary), WORDS)]


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = "".join(f"^{w}$" for w in words)
    c = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(7)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = np.arange(len(c)) - starts[owner]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _BASE)]), dtype=np.uint64)
    slot = lambda h, salt: (((h + np.uint64(salt)) * _MIX >> np.uint64(45)) % np.uint64(SLOTS)).astype(np.int32)
    which, slots = [np.arange(len(sizes), dtype=np.int32)], [slot(np.add.reduceat(c * powers[place], starts), 11)]
    h = c
    for n in range(2, 6):
        h = h[:-1] * _BASE + c[n - 1 :]
        if n < 3:
            continue
        inside = owner[: len(h)] == owner[n - 1 :]
        which.append(owner[: len(h)][inside])
        slots.append(slot(h[inside], n))
    whose = np.concatenate(which)
    return np.concatenate(slots)[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))


def summed(w: np.ndarray, blocks) -> np.ndarray:
    """The sum of w over each word's features."""
    return np.concatenate([np.add.reduceat(w[slots], np.cumsum(sizes) - sizes) for slots, sizes in blocks]) if blocks else np.empty(0)


def chunks(lengths: np.ndarray) -> np.ndarray:
    """Positions (n, SEQUENCE) of words laid end to end, by sequence; -1: none. No sequence crosses documents."""
    starts = np.cumsum(lengths) - lengths
    n = -(-lengths // SEQUENCE)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = (starts[doc] + k * SEQUENCE)[:, None] + np.arange(SEQUENCE)
    return np.where(at < (starts + lengths)[doc][:, None], at, -1)


class Tagger:
    """Two-tag CRF: e (emission of the toxic tag against the clean one), A (transition scores), s (start)."""

    def __init__(self):
        self.w = np.zeros(SLOTS, np.float32)
        self.bias, self.A, self.s = -4.0, np.array([[1.0, -1.0], [0.0, 0.0]]), np.array([0.0, 0.0])
        self.pool = np.array([-3.0, 3.0, 0.0, 0.0, 0.0])

    def emissions(self, blocks) -> np.ndarray:
        """Of each word of a vocabulary, from its features."""
        return self.bias + summed(self.w, blocks)

    def marginals(self, e: np.ndarray, seq: np.ndarray, pairs: bool = False):
        """Posterior of the toxic tag of each word; with pairs also summed transition and start posteriors."""
        x, mask = np.where(seq >= 0, e[seq], 0.0), seq >= 0
        E, n, T = np.exp(self.A), len(seq), seq.shape[1]
        x = np.clip(x, -30, 30)
        up, down = np.where(x > 0, 1.0, np.exp(x)), np.where(x > 0, np.exp(-x), 1.0)  # potentials of toxic and clean
        a0, a1 = np.empty((T, n)), np.empty((T, n))
        p0, p1 = np.exp(self.s[0]) * down[:, 0], np.exp(self.s[1]) * up[:, 0]
        for t in range(T):
            if t:
                p0, p1 = (p0 * E[0, 0] + p1 * E[1, 0]) * down[:, t], (p0 * E[0, 1] + p1 * E[1, 1]) * up[:, t]
            z = p0 + p1
            p0, p1 = p0 / z, p1 / z
            a0[t], a1[t] = p0, p1
        b0, b1 = np.ones(n), np.ones(n)
        out = np.empty((T, n))
        trans, mT = np.zeros((2, 2)), mask.T
        for t in range(T - 1, -1, -1):
            q0, q1 = a0[t] * b0, a1[t] * b1
            out[t] = q1 / (q0 + q1)
            if t:
                w0, w1 = down[:, t] * b0, up[:, t] * b1
                if pairs:
                    u = np.array([[a0[t - 1] * E[0, 0] * w0, a0[t - 1] * E[0, 1] * w1], [a1[t - 1] * E[1, 0] * w0, a1[t - 1] * E[1, 1] * w1]])
                    trans += (u / u.sum(axis=(0, 1)) * mT[t]).sum(axis=2)
                c0, c1 = E[0, 0] * w0 + E[0, 1] * w1, E[1, 0] * w0 + E[1, 1] * w1
                z = c0 + c1
                # beyond a sequence's end nothing is said: its backward messages begin at its last word
                b0, b1 = np.where(mT[t], c0 / z, 1.0), np.where(mT[t], c1 / z, 1.0)
        p = np.zeros(len(e))
        p[seq[mask]] = out.T[mask]
        return (p, trans, np.array([1 - out[0].mean(), out[0].mean()]) * n) if pairs else p

    def pooled(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per document: 1, greatest marginal, log of the expected number of toxic words, their share, second greatest.

        Words below ``LEAST`` do not count: in a very long document they would add up."""
        out = np.zeros((len(lengths), 5))
        out[:, 0] = 1
        at = 0
        for i, n in enumerate(lengths.tolist()):
            if n:
                own = p[at : at + n]
                top = np.partition(own, n - 2)[-2:] if n > 1 else np.array([0.0, own[0]])
                s = own[own >= LEAST].sum()
                out[i, 1:] = top[1], np.log1p(s), min(1.0, 10 * s / n), top[0]
            at += n
        return out

    def score(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(p, lengths) @ self.pool, -30, 30)))


def _words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, word numbers of the texts laid end to end, words of each text."""
    known: dict[str, int] = {}
    parts = [np.array([known.setdefault(w, len(known)) for w in tokens(t)], np.int32) for t in texts]
    return list(known), np.concatenate(parts) if parts else np.empty(0, np.int32), np.array([len(p) for p in parts], np.int64)


def weak_labels(ids: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, blocks) -> np.ndarray:
    """Token labels from document labels: 1 in toxic documents where a feature of the word speaks for it."""
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    slots, sizes = (np.concatenate(x) for x in zip(*blocks, strict=True))
    first = np.cumsum(sizes) - sizes
    counts = np.zeros((2, SLOTS))
    at = 0
    for label, n in zip(toxic.tolist(), lengths.tolist(), strict=True):  # a feature once a document
        own = np.unique(ids[at : at + n])
        at += n
        k = sizes[own]
        if len(own):
            counts[label][np.unique(slots[np.repeat(first[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())])] += 1
    n0, n1 = max(1, (toxic == 0).sum()), max(1, (toxic == 1).sum())
    odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
    sure = odds - np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    good = (sure > SURE) & (counts[1] >= 3)
    word = summed(good.astype(np.int32), blocks) > 0
    return (word[ids] & (toxic[doc] == 1)).astype(np.float64)


def fit(texts: list[str | None], toxic: list[int], odds: float | None = None, seed: int = 3) -> Tagger:
    """Fits on labelled documents. Without any, or with one label alone, scores stay near that label's share.

    ``odds`` of the toxic label among all labelled rows correct the score where the sample holds the labels in another ratio."""
    model, y = Tagger(), np.array(toxic, np.int64)
    if len(y) == 0 or y.min() == y.max():
        model.pool = np.array([2.0 if len(y) and y[0] == 1 else -3.0, 0, 0, 0, 0])
        return model
    held = np.random.default_rng(seed).random(len(y)) < CALIBRATION
    if min(np.bincount(y[held], minlength=2)) < 2 or min(np.bincount(y[~held], minlength=2)) < 2:
        held[:] = False
    vocabulary, ids, lengths = _words([t for t, h in zip(texts, held, strict=True) if not h])
    if not len(ids):
        return model
    blocks = features(vocabulary)
    gold = weak_labels(ids, lengths, y[~held], blocks)
    seq = chunks(lengths)
    told = np.zeros(len(ids), bool)  # sequences of toxic documents that no token label explains say nothing
    doc = np.repeat(np.arange(len(lengths)), lengths)
    explained = np.bincount(doc, gold, len(lengths)) > 0
    told = (y[~held][doc] == 0) | explained[doc]
    seq = seq[[bool(told[r[0]]) for r in seq]]
    rng = np.random.default_rng(seed)
    pos = np.array([gold[r[r >= 0]].any() for r in seq], bool)
    rest = np.flatnonzero(~pos)
    seq = np.concatenate([seq[pos], seq[rng.permutation(rest)[: max(CLEAN_SEQUENCES, CLEAN_RATIO * int(pos.sum()))]]])
    mask = seq >= 0
    real = np.zeros((2, 2))
    g = np.where(mask, gold[seq], 0).astype(int)
    np.add.at(real, (g[:, :-1][mask[:, 1:]], g[:, 1:][mask[:, 1:]]), 1)
    starts = np.bincount(g[:, 0], minlength=2).astype(float)
    used = seq[mask]
    total = np.bincount(ids[used], gold[used], len(vocabulary))
    m = {k: 0.0 for k in "wbAs"}
    v = {k: 0.0 for k in "wbAs"}
    for step in range(1, ITERATIONS + 1):
        e = model.emissions(blocks)[ids]
        p, trans, begun = model.marginals(e, seq, pairs=True)
        miss = np.bincount(ids[used], p[used], len(vocabulary)) - total
        slope, at = REGULAR * model.w.astype(np.float64), 0
        for slots, sizes in blocks:
            slope += np.bincount(slots, np.repeat(miss[at : at + len(sizes)], sizes), SLOTS)
            at += len(sizes)
        grads = {"w": slope, "b": miss.sum(), "A": trans - real + 0.1 * model.A, "s": begun - starts + 0.1 * model.s}
        rates = {"w": 0.12, "b": 0.15, "A": 0.1, "s": 0.1}
        for k, grad in grads.items():
            m[k], v[k] = 0.85 * m[k] + 0.15 * grad, 0.95 * v[k] + 0.05 * grad**2
            move = rates[k] * (m[k] / (1 - 0.85**step)) / (np.sqrt(v[k] / (1 - 0.95**step)) + 1e-3)
            if k == "w":
                model.w -= move.astype(np.float32)
            elif k == "b":
                model.bias -= float(move)
            elif k == "A":
                model.A = model.A - move
            else:
                model.s = model.s - move
    del blocks, seq, gold, ids, told, used  # the calibration half takes their place
    rows = held if held.any() else ~held
    vocabulary, ids, lengths = _words([t for t, h in zip(texts, rows, strict=True) if h])
    x = model.pooled(model.marginals(model.emissions(features(vocabulary))[ids], chunks(lengths)) if len(ids) else np.empty(0), lengths)
    beta, prior = np.array([-2.0, 2.0, 1.0, 0.0, 1.0]), np.diag([0.01, 0.3, 0.3, 0.3, 0.3])
    centre = beta.copy()
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + prior, x.T @ (y[rows] - q) - prior @ (beta - centre))
        beta = beta + np.clip(step, -2, 2)
    if odds:
        beta[0] += np.log(odds) - np.log((y[rows] == 1).sum() / max(1, (y[rows] == 0).sum()))
    model.pool = beta
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, chars: int = MAX_LABELLED_CHARS) -> tuple[list, list, float]:
    """At most ``most`` labelled documents outside the held-out fold, half of each label where there are so many, of ``chars``
    characters at most in all.

    Which rows: those with the smallest hash of doc_id, as long as their texts add up to half of ``chars`` a label; texts of more
    than a sixteenth of it are passed over. A doc_id with several labels is toxic if one of them says so; one with several texts
    stands for the smallest. Null ids and other labels take no part. Top-k per label runs partially in each task, so no task
    sorts a whole label. With the sample, the odds of the toxic label among all labelled rows."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    narrow = common.only(labels, doc_id="long", toxic="int").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [narrow.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    rows = common.only(docs, doc_id="long", text="string").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = common.stored(rows, "toxicity-sample")  # ``most`` rows at most
    sizes = rows.select("doc_id", "toxic", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size")).where(F.col("size") <= chars // 16)
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= chars // 2).select("doc_id")
    got = sorted(rows.join(F.broadcast(drawn), "doc_id", "left_semi").collect(), key=lambda r: r.doc_id)
    n = {r.toxic: r["count"] for r in narrow.groupBy("toxic").count().collect()}
    return [r.text for r in got], [r.toxic for r in got], (n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5)


def tag(texts: list[str | None], model: Tagger) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores of the texts, and the marginals of their words."""
    vocabulary, ids, lengths = _words(texts)
    p = model.marginals(model.emissions(features(vocabulary))[ids], chunks(lengths)) if len(ids) else np.empty(0)
    return model.score(p, lengths), np.split(p, np.cumsum(lengths)[:-1]) if len(texts) else []


def portions(texts: list[str | None]):
    """Slices of the texts of about CHARS characters."""
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= CHARS or i + 1 == len(texts):
            yield slice(a, i + 1)
            a, n = i + 1, 0


def score_documents(docs: DataFrame, model: Tagger, least: float = 0.5) -> DataFrame:
    """Per document: doc_id, score (0 to 1) and spans [start, stop) in code points of the words whose marginal is ``least`` or more.

    Null and empty texts have no words; their score is that of a document without toxic words. Rows that repeat stay rows of
    their own, null doc_ids stay null, extra columns are ignored, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights: 2 MB
    schema = "doc_id long, score double, spans array<struct<start: int, stop: int>>"

    def run(batch):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in portions(texts):
            scores, marginals = tag(texts[part], sent.value)
            spans = []
            for text, p in zip(texts[part], marginals, strict=True):
                bad = set(np.flatnonzero(p >= least).tolist())
                low = text.lower() if bad else ""
                if len(low) != len(text or "") and bad:  # lowering changed the length: no offsets of single words
                    spans.append([{"start": 0, "stop": len(text)}])
                else:
                    spans.append([{"start": m.start(), "stop": m.end()} for i, m in enumerate(_WORD.finditer(low)) if i in bad])
            yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(scores), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["doc_id", "score", "spans"])

    return common.map_batches(common.only(docs, doc_id="long", text="string"), run, schema)


def drop_toxic(docs: DataFrame, model: Tagger, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold.

    Null and empty texts score as one without toxic words; repeated rows are judged alike; other columns may have any name; an empty
    table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        keep = np.concatenate([tag(texts[part], sent.value)[0] < threshold for part in portions(texts)])
        yield batch.filter(pa.array(keep))

    return common.map_batches(docs, run, docs.schema)


def trained(spark: SparkSession, sf_dir: str, most: int = MAX_LABELLED) -> Tagger:
    return fit(*labelled_sample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), most))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, one row each, scored by a model of the labels outside the held-out fold; a null doc_id has a null held_out.
    Nulls, repeats, extra columns and empty tables as in ``score_documents`` and ``labelled_sample``."""
    found = score_documents(common.table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
