"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: one record a page. Payloads of ``min_bytes`` or more that are equal (SHA-1 and length) share one ``response`` record,
that of the largest page_id; the others are ``revisit`` records that refer to it. Archives are WARC/1.1 files, each record a gzip
member of its own. Spark's text writer lays the members down, so any Hadoop file system holds them and a retried task leaves
nothing behind; the line separator that this writer puts after each row is the zero byte that a member ends with.

Reading: a payload may itself hold text that looks like a record. Tasks inflate archives piece by piece, parse every place
where the magic line stands and emit record-to-successor offsets; pointer jumping from offset 0 of each file then keeps only the
records that the chain reaches, so magic inside payloads is rejected. A chain that does not end where its file does raises: no
record is lost unseen.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"WARC/1.1\r\n"
MIN_BYTES = 1000
FILE_BYTES = 16 << 20  # aimed at for one archive file
MOST_BYTES = 1 << 28  # that no archive file exceeds (with one record at least), as a reader task is given whole files
LEVEL = 6  # of compression
PIECE = 1 << 20  # bytes inflated at a time
RECORDS = "file string, at long, next long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, sound boolean, size long"


def _record(block: Column) -> Column:
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20"))).otherwise(""),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, block, F.lit("\r\n\r\n"))


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member of these bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_EMPTY = member(b"")


def _cut_member(data: bytes) -> bytes:
    """A gzip member short of its last byte, which is zero: the top byte of its length, where that is below 2^24. A larger one is
    followed by an empty member, which ends so."""
    whole = member(data)
    return whole[:-1] if whole[-1] == 0 else whole + _EMPTY[:-1]


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, html) as archives under path.

    A null html is an empty payload, a null url leaves the target out, extra columns are ignored. Rows that repeat a page_id
    are records of their own; among equal payloads with the same largest page_id each of those rows is a response. A null
    page_id is smaller than any other and its response refers to nothing.

    Files hold as many records as their mean size allows, and no more than their largest size does.
    Only digests are grouped (with map-side partial aggregation); a payload that a third of all pages share makes one long
    run of the join on the digest, which adaptive execution splits, as that side is streamed."""
    base = common.only(pages, page_id="long", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumns({"payload_digest": F.sha1(F.encode("html", "UTF-8")), "payload_bytes": F.octet_length("html").cast("long")})
    groups = (
        base.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    groups = common.stored(groups, "warc-groups")  # a side of its own: only joins of plain exchanges have their skew split
    kinds = base.join(groups, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
        F.when(again, "").otherwise(F.col("html")),
    )
    sizes = F.col("payload_bytes") + F.coalesce(F.octet_length("url"), F.lit(0))
    escaped = F.col("payload_bytes") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)).cast("long")  # at most, with every character as %20
    most, mean = base.agg(F.max(escaped), F.avg(sizes)).first()
    records_a_file = max(1, min(int(file_bytes // ((mean or 0) + 512)), MOST_BYTES // ((most or 0) + 4096)))
    records = kinds.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("_first"))})

    def pack(batch):
        yield pa.RecordBatch.from_arrays([pa.array([_cut_member(x.as_py().encode()) for x in batch.column(0)], pa.binary())], names=["value"])

    members = common.map_batches(records.select(_record(block).alias("value")), pack, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_a_file).text(path)


_ID = re.compile(rb"<urn:page:(-?\d+|null)>")


MORE = ()  # what _parse gives where the record goes beyond the bytes at hand


def _parse(data: bytes | bytearray, at: int, last: bool = True) -> tuple | None:
    """(length, page_id, type, refers_to, payload bytes, digest, sound) of the record that would begin at this offset; None: no record.

    last: no bytes follow data; else MORE where some are wanted."""
    split = data.find(b"\r\n\r\n", at)
    if split < 0:
        return None if last else MORE
    head = {}
    for line in bytes(data[at:split]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head.setdefault(name.strip().lower(), value.strip())
    try:
        length = int(head[b"content-length"])
        kind = head[b"warc-type"].decode("ascii")
    except (KeyError, ValueError):
        return None
    start, stop = split + 4, split + 4 + length
    if length >= 0 and stop + 4 > len(data) and not last:
        return MORE
    if length < 0 or data[stop : stop + 4] != b"\r\n\r\n":
        return None
    own, ref = _ID.fullmatch(head.get(b"warc-record-id", b"")), _ID.fullmatch(head.get(b"warc-refers-to", b""))
    number = lambda m: int(m[1]) if m and m[1] != b"null" else None
    digest, size, sound = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace"), None, True
    digest = base64.b32decode(digest).hex() if len(digest) == 32 and digest.isupper() else digest.lower()
    if head.get(b"content-type", b"").startswith(b"application/http"):
        body = data.find(b"\r\n\r\n", start, stop)
        if body < 0:
            return None
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[start:body])
        size = int(m[1]) if m else None
        payload = data[body + 4 : stop]
    else:
        payload = data[start:stop]
    if kind != "revisit":
        sound = not digest or hashlib.sha1(payload).hexdigest() == digest
        digest, size = digest or hashlib.sha1(payload).hexdigest(), len(payload)
    return stop + 4 - at, number(own), kind, number(ref), size, digest, sound


def pieces(content: bytes):
    """The plain bytes of an archive, some PIECE at a time: those of its gzip members in turn, or its own where it is plain."""
    view = memoryview(content)
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(view), PIECE):
            yield bytes(view[at : at + PIECE])
        return
    at = 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof:
            some = view[at : at + (PIECE >> 2)]
            if not some:
                raise ValueError("an archive ends within a gzip member")
            at += len(some)
            out = z.decompress(some, PIECE)
            while out:
                yield out
                out = z.decompress(z.unconsumed_tail, PIECE) if z.unconsumed_tail else b""
        at -= len(z.unused_data)
        while at < len(view) and view[at] == 0:  # padding between members
            at += 1


def records(stream) -> tuple[list[tuple], int]:
    """(offset, next, ...) of every place in a stream of plain bytes where a record may begin, and the stream's length.

    At hand are the bytes from the first place that is still undecided: a record's length, as a rule."""
    data, base, rows, waiting, sought, before = bytearray(), 0, [], [], 0, len(MAGIC) + 3

    def settle(last: bool) -> None:
        nonlocal data, base, waiting, sought
        at = data.find(MAGIC, sought)
        while at >= 0:
            if base + at == 0 or data[max(0, at - 4) : at] == b"\r\n\r\n":
                waiting.append((base + at, 0))
            at = data.find(MAGIC, at + 1)
        sought = max(0, len(data) - len(MAGIC) + 1)
        left = []
        for place, need in waiting:
            found = _parse(data, place - base, last) if last or len(data) >= need else MORE
            if found == MORE and found is not None:
                left.append((place, need if len(data) < need else len(data) + min(len(data) - (place - base), PIECE)))
            elif found:
                rows.append((place, place + found[0], *found[1:]))
        waiting = left
        keep = min([place - base for place, _ in waiting] + [max(0, len(data) - before)])
        if keep:
            waiting = [(place, need - keep) for place, need in waiting]
            del data[:keep]
            base, sought = base + keep, max(0, sought - keep)

    for piece in stream:
        data += piece
        settle(False)
    size = base + len(data)
    settle(True)
    return sorted(rows), size


def candidates(files: DataFrame) -> DataFrame:
    """Every place in the files (path, content) where a record may begin, parsed, with the offset of its successor."""

    def run(batch):
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, size = records(pieces(content.as_py()))
            if size and (not rows or rows[0][0]):
                raise ValueError(f"{path.as_py()}: no record at offset 0")
            if rows:
                rows = [(path.as_py(), *r, size) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return common.map_batches(files.select("path", "content"), run, RECORDS)


def reachable(at: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping.

    Marks spread from the start over jumps of 1, 2, 4, ... records, so a file of n records takes log2(n) rounds."""
    order = np.argsort(at, kind="stable")
    at, successor = at[order], successor[order]
    n = len(at)
    where = np.searchsorted(at, successor)
    jump = np.where((where < n) & (at[np.minimum(where, n - 1)] == successor), where, n)
    jump = np.append(jump, n)  # n: past the end
    mark = np.append(at == 0, False)
    while True:
        mark[jump[np.flatnonzero(mark)]] = True
        mark[n] = False
        if (jump == n).all():
            break
        jump = jump[jump]
    out = np.empty(n, bool)
    out[order] = mark[:n]
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under path, verified: page_id, record_type, refers_to, payload_bytes, payload_digest, sound.

    Files may be plain or under gzip, in one member or many; offsets are those of the plain bytes. ``sound`` tells whether a
    payload has the digest its header names. Offsets alone are brought together per file (some 16 bytes a record, bounded by the
    file's size); payloads stay where they are read, and go when their record is parsed. A file whose chain breaks before its end
    raises, with its name and the offset; empty files have no records, and no file at all gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    found = common.stored(candidates(files), "warc-candidates")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pdf[reachable(pdf["at"].to_numpy(), pdf["next"].to_numpy())]
        if kept["next"].max() != pdf["size"].iloc[0]:
            raise ValueError(f"{pdf['file'].iloc[0]}: the chain of records ends at offset {kept['next'].max()} of {pdf['size'].iloc[0]}")
        return kept[["file", "at"]]

    kept = found.select("file", "at", "next", "size").groupBy("file").applyInPandas(chain, "file string, at long")
    return found.join(kept, ["file", "at"], "left_semi").select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "sound")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as archives, read back: one row a page. Null html is an empty payload, a null page_id stays null, repeated rows stay
    rows of their own, extra columns go, an empty table gives no rows."""
    path = common.new_path(spark, "warc")
    write_warc(common.table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""
