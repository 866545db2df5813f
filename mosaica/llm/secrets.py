"""Secret scans: pattern candidates, and encoded candidates confirmed by their structure.

Assignments, access keys and long hex runs are base findings. Beyond them candidates are decoded, and reported only if the
bytes parse: private keys in DER (nested lengths must add up to the whole, and the fields must be those of PKCS#1, PKCS#8 or
SEC 1), OpenSSH private keys (magic, then nested length-prefixed strings), and signed tokens (three base64url parts, the first a
JSON header that names its algorithm). Candidates are base64, base64url and hex runs, whole, from each place within where such
a structure could begin, or wrapped over lines of one width; and PEM armour of any length, with headers or without, whose line ends
may be written out as backslash and n. Encrypted PEM has no structure to parse: its headers and whole base64 confirm it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .spans import Span, digest, joined

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")

# Patterns of the contract.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a greedy run of 24 or more is just a maximal run that is not too short

_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_LINE_END = re.compile(r"\\r\\n|\\n|\\r|\r\n|\n|\r")
_ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED")
_RUN = r"[A-Za-z0-9+/_-]"
_ENCODED = re.compile(rf"(?<!{_RUN}){_RUN}{{40,}}+={{0,2}}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+(?:(?:\\r)?\\n|\r?\n)[A-Za-z0-9+/\\\r\n]++={0,2}")
_STARTS = re.compile(r"M[B-I]|b3BlbnNzaC1rZXktdjEA")  # how base64 of a DER sequence of 16 bytes or more, and of the OpenSSH magic, begins
_HEX_ANY = re.compile(r"[0-9A-Fa-f]{48,}")
_HEX_STARTS = re.compile(r"30|6f70656e7373682d6b65792d763100", re.IGNORECASE)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,}+)(\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+))")
_OBJECT = re.compile(r"e(?:y[A-DI-L]|w[k-r0-3])|^[CDI]")  # how base64 of { and a quote or white space, or of white space, begins


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


# ---------------------------------------------------------------- structure
def der(data: bytes) -> list[tuple[int, bytes, list]] | None:
    """Tag-length-value items that fill data exactly: (tag, value, items of a constructed one). None: they do not.

    All nesting is checked, however deep; items are told down to the third level."""
    top: list = []
    stack = [(len(data), top)]  # where an open item must end, its items; innermost last
    at = 0
    while stack:
        stop, out = stack[-1]
        if at == stop:
            stack.pop()
            continue
        if at + 2 > stop:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if tag & 0x1F == 0x1F:
            return None
        if size & 0x80:
            n = size & 0x7F
            if not 0 < n <= 4 or at + n > stop or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > stop:
            return None
        items: list | None = [] if len(stack) < 3 else None
        if out is not None:
            out.append((tag, data[at : at + size], [] if items is None else items))
        if tag & 0x20:
            stack.append((at + size, items))
        else:
            at += size
    return top


def _first_der(data: bytes) -> int:
    """How many bytes the DER sequence takes that data begins with, by its own length; 0: it begins with none."""
    if len(data) < 6 or data[0] != 0x30:
        return 0
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if n > 4 or data[1] == 0x80:
        return 0
    return 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])


def private_der(data: bytes) -> bool:
    """Whether data is one PKCS#1, PKCS#8 (plain or encrypted) or SEC 1 private key, to the last byte."""
    if len(data) < 24 or data[0] != 0x30 or not (top := der(data)) or len(top) != 1:
        return False
    items = top[0][2]
    tags = [t for t, _, _ in items]
    small = items[0][1] in (b"\0", b"\1") if items else False
    if len(items) >= 9 and tags[:9] == [2] * 9 and small:  # version, modulus, exponents, primes, coefficients
        return True
    if len(items) >= 3 and tags[0] == 2 and small and tags[1] == 0x30 and tags[2] == 4:  # version, algorithm, key
        return bool(items[1][2]) and items[1][2][0][0] == 6
    if len(items) >= 2 and tags[0] == 2 and items[0][1] == b"\1" and tags[1] == 4:  # version, key, [0] curve, [1] point
        return len(items[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if len(items) == 2 and tags == [0x30, 4] and items[0][2] and items[0][2][0][0] == 6:  # algorithm, encrypted key
        return len(items[1][1]) >= 16
    return False


def private_ssh(data: bytes) -> bool:
    """Whether data is an OpenSSH private key: magic, then length-prefixed strings whose lengths add up."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, strings = len(magic), 0
    for what in "sssn*":
        if what == "n":
            if at + 4 > len(data) or not 1 <= (keys := struct.unpack_from(">I", data, at)[0]) <= 16:
                return False
            at += 4
            continue
        for _ in range(keys + 1 if what == "*" else 1):
            if at + 4 > len(data):
                return False
            size = struct.unpack_from(">I", data, at)[0]
            at += 4 + size
            strings += 1
            if at > len(data):
                return False
    return at == len(data) and strings >= 5


def decoded(run: str) -> bytes | None:
    """The bytes that a base64 or base64url run stands for."""
    core = run.rstrip("=")
    if len(core) % 4 == 1 or ("+" in core or "/" in core) and ("-" in core or "_" in core):
        return None
    try:
        return base64.b64decode(core.translate({45: 43, 95: 47}) + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(run: str) -> bool:
    """Whether three dotted parts are a signed token: a JSON object header with ``alg``, a JSON object of claims."""
    head, claims, signature = run.split(".")
    try:
        parts = [json.loads(decoded(x) or b"") for x in (head, claims)]
    except (ValueError, RecursionError):
        return False
    if not all(isinstance(x, dict) for x in parts) or not isinstance(parts[0].get("alg"), str):
        return False
    return parts[0]["alg"].lower() == "none" or (raw := decoded(signature)) is not None and len(raw) >= 16


def _key_kind(data: bytes | None) -> str | None:
    return None if not data else "der" if private_der(data) else "ssh" if private_ssh(data) else None


def _within(run: str) -> tuple[str, int, int] | None:
    """(kind, start, stop) of the first key that begins somewhere within a base64 run, its own length telling where it ends."""
    for m in _STARTS.finditer(run):
        head = decoded(run[m.start() : m.start() + 16]) or b""
        size = _first_der(head) if head[:1] == b"0" else len(head)
        if not size:
            continue
        stop = m.start() + (-(-size * 4 // 3) if head[:1] == b"0" else len(run))
        if stop > len(run.rstrip("=")):
            if head[:1] == b"0":
                continue
            stop = len(run)
        while stop < len(run) and run[stop] == "=" and (stop - m.start()) % 4:
            stop += 1
        if kind := _key_kind(decoded(run[m.start() : stop])):
            return kind, m.start(), stop
    return None


def structural_spans(text: str) -> list[Span]:
    """Findings that are confirmed by their structure; those within a longer one are left out."""
    found: list[Span] = []
    if "-----BEGIN" in text:
        at = 0
        while m := _BEGIN.search(text, at):
            at, end = m.end(), f"-----END {m[1]}-----"
            stop = text.find(end, at)
            if stop < 0 or text.find("-----BEGIN", at, stop) >= 0:
                continue
            lines = _LINE_END.split(text[at:stop])
            data = decoded("".join("".join(x for x in lines if ":" not in x).split()))  # RFC 1421 headers hold a colon
            if _key_kind(data) or data and _ENCRYPTED.search(text, at, stop):
                at = stop + len(end)
                found.append(("pem", m.start(), at))
    free = lambda a: not any(x <= a < b for _, x, b in found)
    if "." in text:
        for m in _JWT.finditer(text):
            for o in _OBJECT.finditer(m[1]):
                if signed_token(m[1][o.start() :] + m[2]) and free(m.start() + o.start()):
                    found.append(("jwt", m.start() + o.start(), m.end(2)))
                    break
    for m in _WRAPPED.finditer(text):
        if m[0][0] not in "Mb" or not free(m.start()):
            continue
        lines = _LINE_END.split(m[0])
        n = next((i for i, x in enumerate(lines) if len(x) != len(lines[0])), len(lines) - 1) + 1  # the last line is the first of another width
        if kind := _key_kind(decoded("".join(lines[:n]))):
            stop = m.start()
            for i, e in zip(range(n), [*_LINE_END.finditer(m[0]), None], strict=False):
                stop = m.start() + (e.start() if e else len(m[0])) if i == n - 1 else stop
            found.append((kind, m.start(), stop))
    for m in _ENCODED.finditer(text):
        if not free(m.start()):
            continue
        if m[0][0] in "Mb" and (kind := _key_kind(decoded(m[0]))):
            found.append((kind, m.start(), m.end()))
        elif hit := _within(m[0]):
            found.append((hit[0], m.start() + hit[1], m.start() + hit[2]))
    for m in _HEX_ANY.finditer(text):
        for s in _HEX_STARTS.finditer(m[0]):
            a = m.start() + s.start()
            if not free(a):
                continue
            raw = bytes.fromhex(m[0][s.start() : s.start() + (len(m[0]) - s.start()) // 2 * 2])
            size = _first_der(raw[:8]) if raw[0] == 0x30 else len(raw)
            if size <= len(raw) and (kind := _key_kind(raw[:size])):
                found.append((kind, a, a + 2 * size))
                break
    return found


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: counts of base findings, the digest of their spans, and all spans.

    A map without exchange; a batch is the most that a task holds. Null and empty texts have no findings. Rows that repeat
    stay rows of their own. Null doc_ids stay null, extra columns are ignored, an empty table gives no rows."""

    def run(batch):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            base, more = base_spans(text), structural_spans(text)
            n = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            rows.append((doc_id, *n, digest(base, KINDS), joined(base + more, KINDS), len(more)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return common.map_batches(common.only(docs, doc_id="long", text="string"), run, SCHEMA)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, one row each; nulls, repeats, extra columns and empty tables as in ``find_secrets``."""
    return find_secrets(common.table(spark, sf_dir, "documents"))
