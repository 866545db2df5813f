"""Word hashes, rolling hashes of word windows, and compact sorted hash lists; shared by the exact-repeat and similarity operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_BASE = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 120_000  # words whose hash a worker remembers


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of so many words; h holds word hashes. By doubling: log2(width) passes."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    power = lambda n: np.uint64(pow(int(_BASE), n, 1 << 64))
    part, size, out, done, bits = h, 1, None, 0, width
    while bits:
        if bits & 1:
            tail = part[done : done + len(h) - width + 1]
            out = tail if out is None else out * power(size) + tail
            done += size
        bits >>= 1
        if bits:
            part = part[:-size] * power(size) + part[size:]
            size *= 2
    return _mixed(out)


def inside(lengths: np.ndarray, width: int) -> np.ndarray:
    """Which windows over texts laid end to end lie in one text."""
    total = int(lengths.sum())
    ok = np.ones(max(0, total - width + 1), bool)
    for end in np.cumsum(lengths)[:-1].tolist():
        ok[max(0, end - width + 1) : end] = False
    return ok


# ---------------------------------------------------------------- sorted lists
def pack(values: np.ndarray, width: int) -> bytes:
    """Ascending distinct values: differences, laid out byte plane by byte plane, so that the exchange's codec removes the
    planes of leading zeros."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    room = np.zeros((n, 8), np.uint8)
    room[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return np.cumsum(room.view("<u8").ravel(), dtype=np.uint64)


class Deal:
    """How hashes, cut to their top ``bits`` bits, are dealt to a power of two of parts: by their topmost bits, so sorted lists are
    cut by slicing, and there is nothing to send with a task."""

    def __init__(self, parts: int, width: int = 4):
        """Parts whose range, and so each value within its part, fits ``width`` bytes (8: whole hashes)."""
        self.parts, self.width = parts, width
        self.top = parts.bit_length() - 1
        if parts != 1 << self.top:
            raise ValueError("the number of parts is no power of two")
        self.bits = min(64, 8 * width + self.top)
        self.shift = np.uint64(self.bits - self.top)

    def cut(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> self.shift if self.top else np.zeros(len(keys), np.uint64)).astype(np.int64)

    def split(self, keys: np.ndarray):
        """(part, slice) of ascending keys, for the parts that have some."""
        if not len(keys):
            return
        own = self.part(keys)
        at = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(keys)]]).tolist()
        for p, a, b in zip(own[at[:-1]].tolist(), at, at[1:], strict=False):
            yield p, slice(a, b)

    def _base(self, part: int) -> np.uint64:
        return np.uint64(part << int(self.shift)) if self.top else np.uint64(0)

    def pack(self, part: int, keys: np.ndarray) -> bytes:
        return pack(keys - self._base(part), self.width)

    def unpack(self, part: int, raw: bytes) -> np.ndarray:
        return unpack(raw, self.width) + self._base(part)


# ---------------------------------------------------------------- chunks
LEAST_CHUNK, MOST_CHUNK, MOST_PART = 1 << 17, 32_000_000, 32_000_000  # characters


def sizes(chars: int) -> tuple[int, int]:
    """(chunks, parts) for so many characters.

    A chunk sends a row to each part, so rows grow with chunks times parts. Both sizes grow with the root of the text, so that
    a row keeps carrying as many hashes, up to what a task can hold: 32 million characters (some 5 million words) in a chunk or
    part. From there rows carry fewer: some 160 hashes at 1 TB, 16 at 10 TB, 2 at 100 TB."""
    root = max(1.0, float(chars)) ** 0.5
    chunk = min(MOST_CHUNK, max(LEAST_CHUNK, int(90 * root)))
    part = min(MOST_PART, max(1, int(360 * root)))
    return max(1, -(-chars // chunk)), 1 << (max(64, -(-chars // part)) - 1).bit_length()


def plan(docs: DataFrame) -> tuple[int, int]:
    """(chunks, parts) for all of docs' text."""
    return sizes(docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0)


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, doc_id, text), exchanged by chunk. Rows are dealt by their number, not by what they hold, so rows that repeat, ids
    and texts alike, go to all chunks. All steps that start from here share the one exchange; the numbers are the same whenever a
    scan is repeated, and docs that are not just read from files are written first."""
    n = max(1, min(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * max(1, chunks // 4096)))
    fixed = docs if common.from_files(docs) else common.stored(docs, "rolling-text")
    keyed = fixed.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text")
    return keyed.repartition(n, "chunk")


def batch(schema: pa.Schema, *columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
