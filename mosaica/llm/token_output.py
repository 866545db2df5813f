"""Token-ID / binary output: patched frame-of-reference (PFOR) shards.

Shard image, little-endian::

    header   magic b"PFOR" | version u16 | block length u16 | ids u64 | documents u64 | blocks u64 | bytes of the packed area u64
    index    blocks+1 x u64: start of each block in the packed area (the last is its end)
    table    documents x u32: ids of each document, end id included
    blocks   minimum u32 | width u8 | exceptions u16 | packed (ceil(n * width / 8) bytes, most significant bit first)
             | exception positions u16 x e | exception values (id minus minimum) u32 x e

Each block holds ``block_length`` consecutive ids (the last may hold fewer). Its minimum is subtracted, the rest packed at the
width that ``percentile`` per cent of the values fit, and larger values are patched from the exception list. The index gives
random access: ``read_ids`` decodes only the blocks that a range of ids touches.

Shards are stored as rows (shard, part, first document ids, image) of a Parquet table in shared storage: Spark's own commit
protocol then makes them whole however often a task is retried, and any Hadoop file system can hold them.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

HEAD = struct.Struct("<4sHHQQQQ")
BLOCK_HEAD = struct.Struct("<IBH")
BLOCK = 512
PERCENTILE = 92
SHARD_IDS = 1 << 21  # ids in a shard, but for a longer document
END_ID = 0
CACHE = 600_000  # pieces a worker remembers

PORTION = 4_000_000  # characters that are encoded at once, but for a longer document
SHORT = 7  # letters of a piece that fit a key

# Character classes of the byte-level vocabulary's piece pattern for text within U+00FF.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = "\\t-\\r \u0085\u00a0"
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
_CLASS = np.array([next(k for k, x in enumerate((_S, _L, _N, "\\x00-\\xff")) if re.match(f"[{x}]", chr(i))) for i in range(256)], np.uint8)


def cut(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of Latin-1 texts begin that are laid end to end, each with one letter after it, at ends, which is a piece.

    Pieces are runs of letters, of numbers, of others, each with the one blank before it; contractions ('s 't 'm 'd 're 've 'll) that
    nothing but a letter or number run comes before; and white space short of that blank, whose last character is a piece of its own
    where it is none and text follows."""
    kind = _CLASS[data]
    kind[ends] = _END
    begins = np.empty(len(data) + 4, bool)
    begins[0] = True
    begins[1 : len(data)] = kind[1:] != kind[:-1]
    begins[ends] = begins[ends + 1] = True
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] > _SPACE) & (kind[1:] < _END))  # of a white-space run that text follows
    begins[last] = True
    begins[last[data[last] == 0x20] + 1] = False
    at = np.flatnonzero((data[:-1] == 0x27) & begins[: len(data) - 1] & (kind[1:] == _LETTER))
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)  # re, ve, ll
    begins[at[short | long] + 1] = False
    begins[at[short] + 2] = begins[at[long & ~short] + 3] = True
    return np.flatnonzero(begins[: len(data)])


# ---------------------------------------------------------------- tokenizer
def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself where it is visible, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class _Pieces:
    """Ids (as little-endian bytes) by piece. Byte-level BPE never merges across pieces, so a text's ids are its pieces' in turn.

    Two generations: when the younger is full the elder goes, so pieces in use stay."""

    def __init__(self, tokenizer):
        self.younger, self.elder = {}, {}
        self.model, self.letters = tokenizer.model, _byte_letters()
        wide = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.spell = f"<u{wide}", [i.to_bytes(wide, "little") for i in range(tokenizer.get_vocab_size())]

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """Ids of each Latin-1 text, and the end id. Pieces of up to SHORT letters are looked up once for all that are equal, by a key
        of their letters and length, which is exact; longer ones one by one."""
        raw = b"\0".join(texts) + b"\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        data = np.frombuffer(raw, np.uint8)
        starts = cut(data, ends)
        sizes = np.diff(starts, append=len(data))
        stop = np.searchsorted(starts, ends)  # the piece that ends each text
        brief = sizes <= SHORT
        brief[stop] = False
        few, some = starts[brief], sizes[brief]
        keys = some.astype(np.uint64) << np.uint64(56)
        for k in range(SHORT):
            part = data[np.minimum(few + k, len(data) - 1)].astype(np.uint64)
            part[some <= k] = 0
            keys |= part << np.uint64(8 * k)
        distinct, which = np.unique(keys, return_inverse=True)
        known = self._all(distinct.tolist(), lambda key: (key & (1 << 56) - 1).to_bytes(SHORT, "little")[: key >> 56].decode("latin-1"))
        many = np.flatnonzero(~brief)
        many = many[~np.isin(many, stop)]
        text = raw.decode("latin-1")
        longer = self._all([text[a:b] for a, b in zip(starts[many].tolist(), (starts[many] + sizes[many]).tolist(), strict=True)], lambda piece: piece)
        flat = np.frombuffer(b"".join(known) + b"".join(longer), self.kind)
        width = flat.dtype.itemsize
        counts = np.array([len(x) for x in known] + [len(x) for x in longer], np.int64) // width
        places = np.cumsum(counts) - counts
        n, at = np.ones(len(starts), np.int64), np.zeros(len(starts), np.int64)
        n[brief], at[brief] = counts[which], places[which]
        n[many], at[many] = counts[len(known) :], places[len(known) :]
        begun = np.cumsum(n) - n
        source = np.repeat(at - begun, n)
        source += np.arange(len(source))
        ids = flat[source].astype(np.uint32) if len(flat) else np.zeros(len(source), np.uint32)
        ids[begun[stop]] = end_id
        return np.split(ids, (begun[stop] + 1)[:-1])

    def _all(self, keys: list, spelled) -> list[bytes]:
        found = list(map(self.younger.get, keys))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self._new(keys[at], spelled)
        return found

    def _new(self, key: int | str, spelled) -> bytes:
        ids = self.younger.get(key) or self.elder.get(key)
        if ids is None:
            piece = spelled(key)
            if piece.isascii() and (piece[1:].isalnum() if piece[0] == " " else piece.isalnum()):  # most are; each letter is written as itself
                written = self.letters[0x20] + piece[1:] if piece[0] == " " else piece
            else:
                written = piece.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = b"".join([self.spell[t.id] for t in self.model.tokenize(written)])
        if len(self.younger) >= CACHE // 2:
            self.elder, self.younger = self.younger, {}
        self.younger[key] = ids
        return ids


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, _Pieces(tokenizer) if _by_pieces(tokenizer) else None, specials


def _by_pieces(tokenizer) -> bool:
    """Whether a tokenizer cuts text as ``cut`` does and encodes each piece by itself: byte-level BPE, and nothing else."""
    cut = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer is not None else {}
    model = tokenizer.model
    return (
        tokenizer.normalizer is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        and type(model).__name__ == "BPE" and not any(getattr(model, k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and tokenizer.truncation is None and tokenizer.padding is None
    )


def encode_all(texts: list[str | None], path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """Ids of each text, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, and the end id. Null: the end id alone.

    Text beyond U+00FF, text that spells a special token, and any text where the tokenizer is not plain byte-level BPE, goes to the
    library whole; other text is cut into the pieces that its pre-tokenizer would make, and the library's model encodes each piece
    that is not remembered."""
    tokenizer, pieces, specials = _tokenizer(path)
    plain, other = [b""] * len(texts), []
    for i, text in enumerate(texts):
        if not text:
            continue
        if pieces is not None and not any(s in text for s in specials):
            try:
                plain[i] = text.encode("latin-1")
                continue
            except UnicodeEncodeError:
                pass
        other.append(i)
    out = pieces.encode(plain, end_id) if pieces is not None and texts else [np.array([end_id], np.uint32)] * len(texts)
    for i in other:
        out[i] = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, end_id], np.uint32)
    return out


def encode_text(text: str | None, path: str) -> np.ndarray:
    """Ids of one text, without an end."""
    return encode_all([text], path)[0][:-1]


def _portions(texts: list[str | None]):
    """Slices of the texts of about PORTION characters."""
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= PORTION or i + 1 == len(texts):
            yield slice(a, i + 1)
            a, n = i + 1, 0


# ---------------------------------------------------------------- PFOR codec
def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, m) values to (n, ceil(m * width / 8)) bytes, most significant bit first."""
    if not width:
        return np.empty((len(values), 0), np.uint8)
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(len(values), -1, 4), axis=2)[:, :, 32 - width :]
    return np.packbits(bits.reshape(len(values), -1), axis=1)


def _unpack(packed: np.ndarray, m: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), m), np.uint32)
    bits = np.unpackbits(packed, axis=1)[:, : m * width].reshape(len(packed), m, width)
    room = np.zeros((len(packed), m, 32), np.uint8)
    room[:, :, 32 - width :] = bits
    return np.packbits(room, axis=2).view(">u4").reshape(len(packed), m).astype(np.uint32)


def _width(deltas: np.ndarray, percentile: float) -> np.ndarray:
    """Bits that the percentile of each row fits."""
    m = deltas.shape[1]
    k = min(m - 1, max(0, int(np.ceil(m * percentile / 100)) - 1))
    return np.frexp(np.partition(deltas, k, axis=1)[:, k].astype(np.float64))[1].astype(np.int64)


def encode_shard(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The shard image of ids (uint32) that belong, in order, to documents of these lengths."""
    ids = np.ascontiguousarray(ids, np.uint32)
    parts: list[bytes] = []
    whole = len(ids) // block * block
    for rows in (ids[:whole].reshape(-1, block), ids[whole:].reshape(-1, max(1, len(ids) - whole))):
        for at in range(0, len(rows), 1024):
            some = rows[at : at + 1024]
            low = some.min(axis=1)
            deltas = some - low[:, None]
            widths, out = _width(deltas, percentile), [b""] * len(some)
            for w in np.unique(widths):
                which = np.flatnonzero(widths == w)
                own = deltas[which]
                packed = _pack(own & np.uint32((1 << int(w)) - 1), int(w))
                patched = own >> np.uint32(w) > 0 if w < 32 else np.zeros(own.shape, bool)
                for i, row in enumerate(which):
                    where = np.flatnonzero(patched[i])
                    out[row] = BLOCK_HEAD.pack(low[row], w, len(where)) + packed[i].tobytes() + where.astype("<u2").tobytes() + own[i][where].astype("<u4").tobytes()
            parts += out
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype("<u8")
    head = HEAD.pack(b"PFOR", 1, block, len(ids), len(lengths), len(parts), int(starts[-1]))
    return b"".join([head, starts.tobytes(), np.asarray(lengths, "<u4").tobytes(), *parts])


def _open(image: bytes):
    magic, version, block, n, docs, blocks, size = HEAD.unpack_from(image)
    if magic != b"PFOR" or version != 1:
        raise ValueError("not a shard image")
    at = HEAD.size
    starts = np.frombuffer(image, "<u8", blocks + 1, at).astype(np.int64)
    lengths = np.frombuffer(image, "<u4", docs, at + 8 * (blocks + 1))
    base = at + 8 * (blocks + 1) + 4 * docs
    if base + size != len(image):
        raise ValueError("shard image is cut short")
    return block, n, starts, lengths, base


def read_ids(image: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a shard; only the blocks that hold them are decoded."""
    block, n, starts, _, base = _open(image)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint32)
    first, last = start // block, (stop - 1) // block
    out = np.empty(min((last + 1) * block, n) - first * block, np.uint32)
    raw = np.frombuffer(image, np.uint8)
    groups: dict[tuple[int, int], list] = {}
    for b in range(first, last + 1):
        low, width, patched = BLOCK_HEAD.unpack_from(image, base + int(starts[b]))
        groups.setdefault((width, min(block, n - b * block)), []).append((b, base + int(starts[b]) + BLOCK_HEAD.size, low, patched))
    for (width, m), found in groups.items():
        size = (m * width + 7) // 8
        for i in range(0, len(found), 1024):
            some = found[i : i + 1024]
            packed = raw[np.array([x[1] for x in some])[:, None] + np.arange(size)] if size else np.empty((len(some), 0), np.uint8)
            values = _unpack(packed, m, width)
            for row, (b, at, low, patched) in zip(values, some, strict=True):
                if patched:
                    where = np.frombuffer(image, "<u2", patched, at + size)
                    row[where] = np.frombuffer(image, "<u4", patched, at + size + 2 * patched)
                out[(b - first) * block : (b - first) * block + m] = row + np.uint32(low)
    return out[start - first * block : stop - first * block]


def shard_lengths(image: bytes) -> np.ndarray:
    return _open(image)[3]


# ---------------------------------------------------------------- operator
SHARDS = "part int, seq int, n_ids long, doc_ids array<long>, image binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK, percentile: float = PERCENTILE, shard_ids: int = SHARD_IDS, as_stored: bool = False) -> DataFrame:
    """Writes documents (doc_id, text) as PFOR shards in ascending doc_id order; returns the shard table as read back.

    ``as_stored``: in the order instead that docs' rows have in the files they are read from (a mix, for example); docs that are
    not read from files go by doc_id.

    Text, not ids, is exchanged (it is the smaller of the two): one range exchange on the order, then each task sorts its
    range, encodes it and cuts shards, so no task holds more than one shard. Ties on doc_id are ordered by text, and the
    exchange may cut inside them. A null text has the end id alone; a null doc_id sorts first. Extra columns are ignored.
    An empty table gives no shard."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    narrow = common.only(docs, doc_id="long", text="string")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    if as_stored and common.from_files(docs):
        number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = [F.col("_part").asc_nulls_first(), F.col("_file"), F.col("_row")]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order, *(["text"] if len(order) == 2 else [])).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []
        doc_ids, n = [], 0

        def shard():
            image = encode_shard(np.concatenate(held), np.array([len(x) for x in held]), block, percentile)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([image], pa.binary())], names=["part", "seq", "n_ids", "doc_ids", "image"])

        for batch in batches:
            own, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in _portions(texts):
                for doc_id, ids in zip(own[some], encode_all(texts[some], tokenizer, end_id), strict=True):
                    if held and n + len(ids) > shard_ids:
                        yield shard()
                        seq, held, doc_ids, n = seq + 1, [], [], 0
                    held.append(ids)
                    doc_ids.append(doc_id)
                    n += len(ids)
        if held:
            yield shard()

    ordered.mapInArrow(run, SHARDS).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(SHARDS).parquet(path)


def read_tokens(shards: DataFrame) -> DataFrame:
    """Per document, from the shard images: doc_id, start, n_tokens, ids_crc32 (and part, seq).

    Starts are a two-level prefix sum: over the parts (one row a task of the writer), then over the shards of each part."""
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    before = F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")
    bases = sizes.join(parts.select("part", before.alias("base")), "part").select(
        "part", "seq", (F.col("base") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("base")
    )
    schema = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"

    def run(batches):
        for batch in batches:
            for part, seq, doc_ids, image in zip(*(batch.column(i) for i in range(4)), strict=True):
                image = image.as_py()
                ids, lengths = read_ids(image).astype("<u4"), shard_lengths(image).astype(np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part.as_py(), np.int32)), pa.array(np.full(k, seq.as_py(), np.int32)), doc_ids.values, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    found = shards.select("part", "seq", "doc_ids", "image").mapInArrow(run, schema)
    return found.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in token files, and what these say of each. Nulls, repeats, extra columns and empty tables as in ``write_tokens``."""
    shards = write_tokens(common.table(spark, sf_dir, "documents"), common.new_path(spark, "tokens"))
    return read_tokens(shards).select("doc_id", "start", "n_tokens", "ids_crc32")
