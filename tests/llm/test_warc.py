import gzip
import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaica.llm import common, warc

from ..oracle import compare, connect

SCHEMA = "page_id long, url string, html string, extra int"


def brute(pages):
    out, best = [], {}
    payloads = [(i, (h or "").encode()) for i, _, h, _ in pages]
    for i, p in payloads:
        best[p] = max(best.get(p, -(1 << 62)), -(1 << 62) if i is None else i)
    for i, p in payloads:
        again = len(p) >= warc.MIN_BYTES and i != best[p] and sum(q == p for _, q in payloads) > 1 and best[p] > -(1 << 62)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", best[p] if again else None))
    return out


def read(spark, pages):
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(pages, SCHEMA).repartition(3), path)
    return [tuple(r) for r in warc.read_warc(spark, path).where("sound").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]


def order(rows):
    return sorted(rows, key=str)


def test_round_trip(spark):
    long = "x" * 1200 + "é"
    trick = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n" * 3
    pages = [(1, "u", long, 0), (2, "u", long, 0), (3, "u", "short", 0), (4, "u", "short", 0), (5, None, None, 0), (6, "a b\n", "", 0), (7, "u", "a\r\n\r\n" + trick + long, 0), (8, "u", "\r\n\r\n" + trick, 0), (9, "u", trick, 0), (9, "u", trick, 0), (None, "u", long, 0), (10, "u", "y" * 300_000, 0)]
    assert order(read(spark, pages)) == order(brute(pages))


def test_long_urls(spark):
    pages = [(i, "data:text/html," + "u" * (200_000 if i % 3 == 0 else 5), f"page {i}", 0) for i in range(20)]
    assert order(read(spark, pages)) == order(brute(pages))


def test_a_broken_chain_raises(spark):
    path = common.new_path(spark, "warc")
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    where = Path(path.removeprefix("file://"))
    where.mkdir(parents=True)
    for data, whole in ((record * 3, True), (record + record.replace(b": 1", b": 9") + record, False), (b"x" + record, False), (record + b"rest", False)):
        (where / "part-0").write_bytes(data)
        if whole:
            assert warc.read_warc(spark, path).count() == 3
        else:
            with pytest.raises(Exception, match="chain of records|no record at offset 0"):
                warc.read_warc(spark, path).count()


def test_a_member_holds_a_record(spark):
    pages = [(i, f"u{i}", "<p>" + "x" * (i * 400), 0) for i in range(9)]
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(pages, SCHEMA).repartition(3), path)
    n = 0
    for f in Path(path.removeprefix("file://")).glob("part-*"):
        left = f.read_bytes()
        while left:
            z = zlib.decompressobj(31)
            data = z.decompress(left)
            assert z.eof and data.startswith(warc.MAGIC) and data.endswith(b"\r\n\r\n")
            assert warc._parse(data, 0)[0] == len(data)
            left, n = z.unused_data, n + 1
    assert n == len(pages)


def test_a_large_record_ends_with_the_zero_byte_too(monkeypatch):
    small, large = warc._cut_member(b"x" * 100), warc._cut_member(bytes(1 << 24))
    assert gzip.decompress(small + b"\0" + large + b"\0" + small + b"\0") == b"x" * 100 + bytes(1 << 24) + b"x" * 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\n", b"WARC/1.1\r\n", b"\r\n\r\n", b"rest"]), max_size=12), st.integers(1, 60))
def test_pieces_of_any_size_give_the_same_candidates(parts, size):
    data = b"".join(parts)
    whole = warc.records([data])
    assert warc.records([data[i : i + size] for i in range(0, len(data), size)]) == whole
    want = [a for a in range(len(data)) if data.startswith(warc.MAGIC, a) and (a == 0 or data[max(0, a - 4) : a] == b"\r\n\r\n") and warc._parse(data, a)]
    assert [r[0] for r in whole[0]] == want and whole[1] == len(data)
    packed = b"".join(warc.member(p) for p in parts)
    assert b"".join(warc.pieces(packed)) == data and b"".join(warc.pieces(warc.member(data))) == data


def test_empty(spark):
    assert read(spark, [(1, "u", "x", 0)]) == brute([(1, "u", "x", 0)])
    path = common.new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_warc(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.data())
def test_chain(sizes, data):
    ends = np.cumsum(sizes)
    at, nxt = np.concatenate([[0], ends[:-1]]), ends
    fake = sorted({data.draw(st.integers(0, int(ends[-1]))) for _ in range(8)} - set(at.tolist()))
    goal = [data.draw(st.sampled_from([*ends.tolist(), *fake])) for _ in fake]
    goal = [max(g, f + 1) for f, g in zip(fake, goal, strict=True)]
    a, s = np.array([*at, *fake], np.int64), np.array([*nxt, *goal], np.int64)
    p = np.random.default_rng(1).permutation(len(a))
    want, here = set(), 0
    after = dict(zip(a.tolist(), s.tolist(), strict=True))
    while here in after:
        want.add(here)
        here = after[here]
    assert set(a[p][warc.reachable(a[p], s[p])].tolist()) == want


def test_whole_table(spark, sf):
    compare(warc.op8_warc(spark, sf), connect(sf), warc.OP8_SQL)


def test_broken_records_are_no_candidates():
    assert warc._parse(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nx\r\n\r\n", 0) is None
    assert warc._parse(b"WARC/1.1\r\nno colon\r\n\r\n", 0) is None
