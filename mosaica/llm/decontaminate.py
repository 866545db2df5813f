"""Benchmark decontamination by a generalised suffix automaton over normalised words.

The driver builds the automaton of a block of items once and broadcasts it as flat arrays. Tasks walk many stretches of text
through it in step, each with its state and the length of its longest match, in array operations.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 500_000  # of items that one automaton holds (some 0.5 GB to build, 30 MB to send); more items make more automata, one pass each
STRETCH = 512  # words that are walked in a row
PORTION = 200_000  # words that are worked on at once, but for a longer document

# Words of the contract. UTF-8 bytes of 0x80 and above belong to characters that are word characters.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normalised(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lowered, cut at every other ASCII character."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower() lowers A-Z alone


class Automaton:
    """Suffix automaton of several word sequences: all their factors, each with the items it occurs in.

    ``windows`` of an item are its factors of ``window`` words, or the whole item where it is shorter (but not empty).
    States are numbers; edges are (state * words + word) in ascending order, with their targets."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary, self.names = window, {}, [name for name, _ in items]
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        full, short = [], []  # (state, item): of each factor that a whole window ends, and of each short item
        for k, (_, words) in enumerate(items):
            last = 0
            for i, w in enumerate(words, 1):
                last = self._extend(nxt, link, length, last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                if i >= window:
                    full.append((last, k))
            if 0 < len(words) < window:
                short.append((last, k))
        self.least = min([window, *(len(w) for _, w in items if w)])
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self.link[0] = 0
        n, v = len(link), max(1, len(self.vocabulary))
        edges = sum(map(len, nxt))
        keys = np.fromiter((s * v + c for s, e in enumerate(nxt) for c in e), np.int64, edges)
        goals = np.fromiter((t for e in nxt for t in e.values()), np.int32, edges)
        del nxt
        order = np.argsort(keys)
        self.edges, self.goals = keys[order], goals[order]
        self.root = np.zeros(v, np.int32)
        for c, t in zip(keys[keys < v].tolist(), goals[keys < v].tolist(), strict=True):
            self.root[c] = t
        # By state: the state of its suffix of just ``window`` words (-1: shorter), and the nearest suffix that is a short item (-1: none)
        self.whole, self.brief = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        ends = np.zeros(n, bool)
        ends[[s for s, _ in short]] = True
        for s in np.argsort(self.length, kind="stable")[1:].tolist():
            up = link[s]
            if length[s] >= window:
                self.whole[s] = s if length[up] < window else self.whole[up]
            self.brief[s] = s if ends[s] else self.brief[up] if up > 0 else -1
        pairs = lambda some: np.unique(np.array(some, np.int64).reshape(-1, 2), axis=0)
        self.full = pairs([(self.whole[s], k) for s, k in full])
        self.short = pairs(short)

    @staticmethod
    def _extend(nxt: list, link: list, length: list, last: int, c: int) -> int:
        def clone(p: int, q: int) -> int:
            r = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = r
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = r
                p = link[p]
            return r

        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else clone(last, q)
        cur, p = len(nxt), last
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else clone(p, q)
        return cur

    def _step(self, state: np.ndarray, n: np.ndarray, c: np.ndarray) -> None:
        """Moves each walk on by a word: to the longest suffix of what it has matched that the word continues."""
        v, left = len(self.root), np.arange(len(state))
        while len(left):
            at_root = state[left] == 0
            some = left[at_root]
            to = self.root[c[some]]
            state[some], n[some] = to, to > 0
            left = left[~at_root]
            keys = state[left].astype(np.int64) * v + c[left]
            at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            there = self.edges[at] == keys
            some = left[there]
            state[some] = self.goals[at[there]]
            n[some] += 1
            left = left[~there]
            state[left] = self.link[state[left]]
            n[left] = self.length[state[left]]

    def scan_all(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list]]:
        """Per text: stretches [start, stop) of words inside occurring windows, merged and ascending, and the names of the items
        whose windows occur, sorted, without repeats (None, the name of items without one, last).

        The automaton is back at its root after any word outside its vocabulary, so only runs of known words that are as long
        as the shortest window are walked. Whether a window ends at a word depends on that many words alone, so long runs are cut
        into stretches that overlap by so many."""
        sizes = np.array([len(w) for w in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a place without a word after each text
        ids = np.full(int(starts[-1]) + 1, -1, np.int64)
        for a, own in zip(starts.tolist(), texts, strict=False):
            ids[a : a + len(own)] = np.fromiter(map(self.vocabulary.get, own, itertools.repeat(-1)), np.int64, len(own))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        begun, ended = edges[::2], edges[1::2]
        long = ended - begun >= self.least
        begun, ended = begun[long], ended[long]
        cuts = -(-(ended - begun) // STRETCH)
        which = np.repeat(np.arange(len(cuts)), cuts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first = begun[which] + nth * STRETCH
        last = np.minimum(first + STRETCH, ended[which])
        first = np.maximum(begun[which], first - self.window + 1)
        order = np.argsort(first - last, kind="stable")  # longest first: those still walking stand in front
        first, length = first[order], (last - first)[order]
        state, n = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
        places, widths, owners = [], [], []
        for t in range(int(length[0]) if len(length) else 0):
            walking = int(np.searchsorted(-length, -t, "left"))
            here, s, m = first[:walking] + t, state[:walking], n[:walking]
            self._step(s, m, ids[here])
            hit = np.flatnonzero(m >= self.window)
            places.append(here[hit])
            widths.append(np.full(len(hit), self.window))
            owners.append(self.whole[s[hit]])
            if len(self.short):
                live, at = np.flatnonzero(self.brief[s] >= 0), self.brief[s[self.brief[s] >= 0]]
                while len(live):
                    fits = self.length[at] <= m[live]
                    places.append(here[live[fits]])
                    widths.append(self.length[at[fits]])
                    owners.append(~at[fits])  # below 0: a short item's state
                    at = self.brief[self.link[at]]
                    live, at = live[at >= 0], at[at >= 0]
        places, widths, owners = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (places, widths, owners))
        depth = np.zeros(len(ids) + 1, np.int32)
        np.add.at(depth, places + 1 - widths, 1)
        np.add.at(depth, places + 1, -1)
        covered = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(depth) > 0).astype(np.int8), [0]])))
        out: list[tuple[list, list]] = [([], []) for _ in texts]
        for a, b in zip(covered[::2].tolist(), covered[1::2].tolist(), strict=True):
            k = int(np.searchsorted(starts, a, "right")) - 1
            out[k][0].append((a - int(starts[k]), b - int(starts[k])))
        whose = np.unique(np.stack([np.searchsorted(starts, places, "right") - 1, owners], axis=1), axis=0) if len(places) else np.empty((0, 2), np.int64)
        named: dict[int, set] = {}
        for k, owner in whose.tolist():
            table, key = (self.full, owner) if owner >= 0 else (self.short, ~owner)
            a, b = np.searchsorted(table[:, 0], [key, key + 1])
            named.setdefault(k, set()).update(self.names[i] for i in table[a:b, 1].tolist())
        for k, names in named.items():
            out[k][1].extend(sorted(names, key=lambda x: (x is None, x or "")))
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list]:
        return self.scan_all([words])[0]


def _scanned(automaton: Automaton, texts):
    """(words, stretches, items) of each text, some PORTION of words at a time."""
    held: list[list[bytes]] = []
    n = 0
    for text in texts:
        own = normalised(text)
        if held and n + len(own) > PORTION:
            yield from ((len(w), *r) for w, r in zip(held, automaton.scan_all(held), strict=True))
            held, n = [], 0
        held.append(own)
        n += len(own)
    if held:
        yield from ((len(w), *r) for w, r in zip(held, automaton.scan_all(held), strict=True))


def _blocks(benchmark: DataFrame, block_words: int):
    """How many blocks of so many words at most (one item at least) the items make, and a function that fetches one of them."""
    items = common.only(benchmark, item_id="string", text="string").where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // (block_words * 6)))
    part = lambda k: items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
    return n, lambda k: [(r[0], r[1]) for r in part(k).orderBy("item_id", "text").collect()]


def _scan(source: DataFrame, block: list[tuple[str | None, str]], window: int) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_words, and the spans and items that one automaton finds."""
    sent = source.sparkSession.sparkContext.broadcast(Automaton([(name, normalised(text)) for name, text in block], window))
    names = ["doc_id", "n_words", "spans", "items"]

    def run(batch):
        found = list(_scanned(sent.value, (t.as_py() for t in batch.column(1))))
        cols = [batch.column(0).to_pylist(), [f[0] for f in found], [[{"start": a, "stop": b} for a, b in f[1]] for f in found], [f[2] for f in found]]
        types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = "doc_id long, n_words long, spans array<struct<start: int, stop: int>>, items array<string>"
    return common.map_batches(source.select("doc_id", "text"), run, schema)


def _merged(numbered: DataFrame, n: int, fetch, window: int) -> DataFrame:
    """Per row of (doc_id, text), doc_id being unique: what the automata of all blocks find in the text, stretches merged."""
    # one block at a time: its pass is written before the next one is fetched
    parts = [common.stored(_scan(numbered, fetch(k), window), "decontaminate-block") for k in range(n)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    merged = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<start: int, stop: int>>), (a, s) -> if(size(a) > 0 and s.start <= element_at(a, -1).stop,"
        " concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(s.stop, element_at(a, -1).stop)))), array_append(a, s)))"
    )
    return merged.select("doc_id", "n_words", joined.alias("spans"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted item_ids), spans ([start, stop) of hit words).

    A broadcast holds one automaton, of items of ``block_words`` words at most; a larger benchmark takes several passes, whose
    stretches are merged per document. Documents are never exchanged in a single pass.
    Null or empty texts have no words. Items with a null text take no part; rows that repeat an item_id are one item with the
    windows of each, and those without an item_id are one item whose name is null. Rows that repeat a doc_id are documents of their own (with several passes, those with equal texts are
    one computation each). Extra columns are ignored."""
    narrow = common.only(docs, doc_id="long", text="string")
    n, fetch = _blocks(benchmark, block_words)
    if n == 1:
        out = _scan(narrow, fetch(0), window)
    else:
        keyed = common.stored(narrow.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
        rows = _merged(keyed.select(F.col("_row").alias("doc_id"), "text"), n, fetch, window).withColumnRenamed("doc_id", "_row")
        out = keyed.select("_row", "doc_id").join(rows, "_row")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")


def clean_text(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of these stretches (and what lies between words of one stretch)."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    where = [m.span() for m in _WORD.finditer(raw)]
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : where[a][0]])
        at = where[b - 1][1]
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents with contaminated stretches cut out; a document covered beyond ``max_coverage`` goes altogether.

    Keeps the columns of docs. Documents without a hit are kept as they are. The automaton is in one broadcast (see
    ``contamination``), and documents stay where they are; of a benchmark beyond that bound each block makes its own pass over
    the uncut documents, and the merged stretches of all blocks are judged and cut once. Null and empty texts are kept; rows that
    repeat are each cut alike; null doc_ids and columns of any other name stay; an empty table gives no rows."""
    fields, columns, spark = docs.schema, docs.columns, docs.sparkSession

    def cut(batch, texts, found):
        """The batch without its covered documents, the others cut; found: (words, stretches) by row."""
        k = batch.schema.get_field_index("text")
        keep, changed = [], False
        for i, (n_words, spans) in enumerate(found):
            if spans:
                if sum(b - a for a, b in spans) > max_coverage * n_words:
                    keep.append(False)
                    continue
                texts[i], changed = clean_text(texts[i], spans), True
            keep.append(True)
        if changed:
            batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
        return batch.filter(pa.array(keep, pa.bool_()))

    n, fetch = _blocks(benchmark, block_words)
    if n == 1:
        sent = spark.sparkContext.broadcast(Automaton([(name, normalised(text)) for name, text in fetch(0)], window))

        def run(batch):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield cut(batch, texts, [(f[0], f[1]) for f in _scanned(sent.value, texts)])

        out = common.map_batches(docs, run, fields)
    else:
        row, where, words = (common.fresh(x, columns) for x in ("_row", "_spans", "_words"))
        keyed = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
        found = _merged(keyed.select(F.col(row).alias("doc_id"), "text"), n, fetch, window).where(F.size("spans") > 0)
        found = common.stored(found.select(F.col("doc_id").alias(row), F.col("spans").alias(where), F.col("n_words").alias(words)), "decontaminate-spans")

        def run(batch):
            told = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in (words, where))
            own = batch.select(columns)
            yield cut(own, own.column(own.schema.get_field_index("text")).to_pylist(), [(m, [(s["start"], s["stop"]) for s in spans or ()]) for m, spans in zip(*told, strict=True)])

        out = common.map_batches(keyed.join(found, row, "left"), run, fields)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(fields["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against benchmark; nulls, repeats, extra columns and empty tables as in ``contamination``. An item_id that is null
    counts as an item and adds nothing to items_sha256."""
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.doc_id, d.i, d.n, d.s FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) d SEMI JOIN win USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ JOIN win USING (n, s)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
