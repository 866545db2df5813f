"""Exact substring dedup with fixed-block anchors.

A window of 35 words holds at least one of its document's non-overlapping 18-word blocks whole. So:

1. every document's blocks are indexed, and every rolling 18-word window of every document is a probe. A probe that meets a block
   elsewhere is a hit;
2. hits are extended to windows: each window that holds a hit's 18 words, at an offset of 0 to 17, is fingerprinted;
3. a fingerprint that occurs more than once is an exact repeat. Overlapping repeated windows make maximal repeats, whose words go.

Work is by chunk (some thousand documents): a chunk sends each distinct hash once to the part that owns its range, with two
bits (seen twice here; a block here), so what a very common passage sends is bounded by the number of chunks; the part sends
back the ones that are repeated. Text is exchanged once, by chunk, and the three steps share that exchange. Hashes
of probes are cut to some 38 bits (a false hit only costs fingerprints); fingerprints have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, rolling

WINDOW = 35
SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("raw", pa.binary()), ("multi", pa.binary()), ("block", pa.binary())])
SENT_SQL = "part int, chunk int, raw binary, multi binary, block binary"
BACK = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("raw", pa.binary())])
BACK_SQL = "chunk int, part int, raw binary"


def _hashed(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts end to end, and the words of each; one text's words are held at a time."""
    parts = [rolling.word_hashes(common.words(t.as_py())) for t in texts]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def _send(chunk: int, keys: np.ndarray, blocks: np.ndarray | None, deal: rolling.Deal) -> pa.Table:
    """Distinct keys of a chunk by part, with a bit for those seen twice and one for those of blocks."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    distinct, counts = ordered[first], np.diff(np.append(first, len(keys)))
    block = np.logical_or.reduceat(blocks[order], first) if blocks is not None and len(first) else np.zeros(len(first), bool)
    rows = [(p, chunk, deal.pack(p, distinct[s]), np.packbits(counts[s] > 1).tobytes(), np.packbits(block[s]).tobytes()) for p, s in deal.split(distinct)]
    return rolling.batch(SENT, *(zip(*rows, strict=True) if rows else [[]] * 5))


def _repeated(deal: rolling.Deal, anchors: bool):
    """For one part: which keys occur twice or more (and, for anchors, are a block somewhere), back to each chunk that sent them."""

    def run(table: pa.Table) -> pa.Table:
        part, chunks = table["part"][0].as_py(), table["chunk"].to_pylist()
        lists = [deal.unpack(part, raw.as_py()) for raw in table["raw"]]
        bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), np.uint8))[: len(x)] for b, x in zip(table[name], lists, strict=True)])
        keys, multi = np.concatenate(lists), bits("multi")
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        good = (np.diff(np.append(first, len(keys))) > 1) | (np.maximum.reduceat(multi[order], first) > 0)
        if anchors:
            good &= np.maximum.reduceat(bits("block")[order], first) > 0
        chosen = ordered[first[good]]
        rows = []
        for chunk, own in zip(chunks, lists, strict=True):
            at = np.searchsorted(chosen, own)
            own = own[(at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == own)] if len(chosen) else own[:0]
            if len(own):
                rows.append((chunk, part, deal.pack(part, own)))
        return rolling.batch(BACK, *(zip(*rows, strict=True) if rows else [[]] * 3))

    return run


def _received(table: pa.Table, deal: rolling.Deal) -> np.ndarray:
    lists = [deal.unpack(p.as_py(), raw.as_py()) for p, raw in zip(table["part"], table["raw"], strict=True)]
    return np.sort(np.concatenate(lists)) if lists else np.empty(0, np.uint64)


def _among(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    if not len(chosen):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(chosen, keys)
    return chosen[np.minimum(at, len(chosen) - 1)] == keys


def _spread(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Places covered by stretches of this width from these starts."""
    edge = np.zeros(total + width + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:total] > 0


def repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text): what is left without words in repeated windows.

    Words are cut at white space. Every occurrence of a repeated window goes, the first too. Null and empty texts have no
    words; texts shorter than a window lose none. Rows that repeat a doc_id are documents of their own, so equal rows repeat
    each other, and any number of equal rows is spread over all chunks. A null doc_id stays null, extra columns are ignored, an empty table gives no rows."""
    block = (window + 1) // 2
    narrow = common.only(docs, doc_id="long", text="string")
    chunks, parts = rolling.plan(narrow)
    text = rolling.chunked(narrow, chunks)
    short, whole = rolling.Deal(parts), rolling.Deal(parts, 8)

    def probe(table: pa.Table) -> pa.Table:
        h, lengths = _hashed(table["text"])
        ok = rolling.inside(lengths, block)
        place = np.arange(len(ok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)[: len(ok)]
        return _send(table["chunk"][0].as_py(), short.cut(rolling.windows(h, block)[ok]), (place % block == 0)[ok], short)

    def extend(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows or not back.num_rows:
            return SENT.empty_table()
        h, lengths = _hashed(table["text"])
        hits = _among(short.cut(rolling.windows(h, block)), _received(back, short)) & rolling.inside(lengths, block)
        at = np.flatnonzero(hits)
        near = _spread(np.maximum(at - block + 1, 0), block, max(0, len(h) - window + 1))
        near &= rolling.inside(lengths, window)
        return _send(table["chunk"][0].as_py(), rolling.windows(h, window)[near], None, whole)

    names = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text
    schema = pa.schema(names)

    def cut(table: pa.Table, back: pa.Table) -> pa.Table:
        h, lengths = _hashed(table["text"])
        gone = np.zeros(len(h), bool)
        if back.num_rows and len(h) >= window:
            hits = _among(rolling.windows(h, window), _received(back, whole)) & rolling.inside(lengths, window)
            gone = _spread(np.flatnonzero(hits), window, len(h))
        rows, at = [], 0
        for doc_id, text in zip(table["doc_id"].to_pylist(), table["text"], strict=True):
            own = common.words(text.as_py())
            bad = gone[at : at + len(own)]
            n = int(bad.sum())
            kept = b" ".join([w for w, g in zip(own, bad.tolist(), strict=True) if not g] if n else own)
            rows.append((doc_id, len(own), n, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "surrogatepass")] * with_text))
            at += len(own)
        return rolling.batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))

    by_chunk = lambda df: df.groupBy("chunk")
    hits = by_chunk(text).applyInArrow(probe, SENT_SQL).groupBy("part").applyInArrow(_repeated(short, True), BACK_SQL)
    marks = by_chunk(text).cogroup(by_chunk(hits)).applyInArrow(extend, SENT_SQL).groupBy("part").applyInArrow(_repeated(whole, False), BACK_SQL)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return by_chunk(text).cogroup(by_chunk(marks)).applyInArrow(cut, out)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, one row each; nulls, repeats, extra columns and empty tables as in ``repeats``."""
    return repeats(common.table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN rep USING (s)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
